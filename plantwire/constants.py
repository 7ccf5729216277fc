"""Ports, protocol names, rule texts and lookup rows.

Every value here is domain data that results depend on; no logic lives here.
"""

# --- fixed values: protocol by port -----------------------------------------
PORT_PROTOCOLS = {
    502: "modbus",
    20000: "dnp3",
    44818: "ethernet_ip",
    2222: "ethernet_ip",
    47808: "bacnet",
    102: "s7comm",
    4840: "opc_ua",
    34962: "profinet",
    34963: "profinet",
    34964: "profinet",
    2404: "iec104",
    1883: "mqtt",
    8883: "mqtt",
    5094: "hart_ip",
    1089: "foundation_fieldbus",
    1090: "foundation_fieldbus",
    1091: "foundation_fieldbus",
    18245: "ge_srtp",
    18246: "ge_srtp",
    5007: "wonderware_suitelink",
    80: "http",
    8080: "http",
    8443: "http",
    443: "https",
    53: "dns",
    22: "ssh",
    3389: "rdp",
    161: "snmp",
    162: "snmp",
}

# --- fixed values: protocol sets ---------------------------------------------
OT_PROTOCOLS = (
    "modbus",
    "dnp3",
    "ethernet_ip",
    "bacnet",
    "s7comm",
    "opc_ua",
    "profinet",
    "iec104",
    "mqtt",
    "hart_ip",
    "foundation_fieldbus",
    "ge_srtp",
    "wonderware_suitelink",
)
IT_PROTOCOLS = ("http", "https", "dns", "ssh", "rdp", "snmp")
# Industrial protocols without the message bus.
ICS_PROTOCOLS = tuple(p for p in OT_PROTOCOLS if p != "mqtt")
# Protocols whose names mark an exposed controller on a public address.
EXPOSED_PROTOCOLS = (
    "modbus", "dnp3", "s7comm", "ethernet_ip", "bacnet", "iec104", "profinet", "opc_ua",
)
# Protocols that make an asset an OT asset in a segmentation profile.
SEGMENT_OT_PROTOCOLS = (
    "modbus", "dnp3", "ethernet_ip", "s7comm", "bacnet", "iec104", "profinet",
    "hart_ip", "ge_srtp", "wonderware_suitelink",
)
# Office protocols that do not belong on a control port.
MASQUERADE_PROTOCOLS = ("http", "https", "ssh", "ftp", "tftp", "smtp", "telnet")
MANAGEMENT_PROTOCOLS = ("snmp", "http", "https", "ssh", "telnet", "netconf")

# --- fixed values: port sets -------------------------------------------------
OT_PORTS = (
    102, 502, 1089, 1090, 1091, 2222, 2404, 4840, 5007, 5094,
    18245, 18246, 20000, 34962, 34963, 34964, 44818, 47808,
)
SERVER_PORTS = tuple(sorted(OT_PORTS + (1883, 8883)))
L1_SERVER_PORTS = (502, 44818, 2222, 102, 20000, 2404, 34962, 34963, 34964)
VNC_PORTS = tuple(range(5900, 5911))
REMOTE_ACCESS_PORTS = (22, 23, 3389) + VNC_PORTS + (5938, 7070)
REMOTE_SERVICE_NAMES = {22: "SSH", 23: "Telnet", 3389: "RDP", 5938: "TeamViewer", 7070: "AnyDesk"}
MANAGEMENT_PORTS = (22, 23, 80, 443, 3389)
CLEARTEXT_OT_PORTS = (
    502, 20000, 44818, 102, 47808, 2404, 34962, 34963, 34964, 4840, 1883, 5094, 18245, 18246,
)
OPC_UA_TLS_PORT = 4843
FILE_TRANSFER_PORTS = {21: "FTP", 69: "TFTP"}
CODESYS_PORT = 2455
UDP_PORTS = (47808, 34962, 34963, 34964, 2222)
ACL_UDP_PORTS = UDP_PORTS + (161, 162, 69, 123, 514)
ACL_UDP_PROTOCOLS = ("bacnet", "profinet", "snmp", "tftp", "dns", "ntp", "syslog", "ssdp")
CANONICAL_PORTS = {
    "modbus": (502,),
    "dnp3": (20000,),
    "ethernet_ip": (44818, 2222),
    "s7comm": (102,),
    "bacnet": (47808,),
    "opc_ua": (4840,),
    "iec104": (2404,),
    "hart_ip": (5094,),
    "ge_srtp": (18245, 18246),
    "wonderware_suitelink": (5007,),
    "foundation_fieldbus": (1089, 1090, 1091),
    "profinet": (34962, 34963, 34964),
    "mqtt": (1883, 8883),
}
EXPECTED_ON_PORT = {
    502: "modbus", 20000: "dnp3", 44818: "ethernet_ip", 102: "s7comm", 47808: "bacnet",
    4840: "opc_ua", 2404: "iec104", 5094: "hart_ip", 18245: "ge_srtp", 18246: "ge_srtp",
    5007: "wonderware_suitelink",
}

# --- fixed values: device types ----------------------------------------------
OT_DEVICE_TYPES = (
    "plc", "rtu", "hmi", "historian", "engineering_workstation",
    "scada_server", "io_server", "field_device", "controller",
)
KNOWN_OT_DEVICE_TYPES = ("plc", "rtu", "hmi", "historian", "engineering_workstation", "scada_server")
FIELD_DEVICE_TYPES = ("plc", "rtu", "field_device")
UNCLASSIFIED_TYPES = ("it_device", "unknown")
LIVE_OT_DEVICE_TYPES = ("plc", "rtu", "hmi", "scada_server", "historian")
SWITCH_TYPES = ("switch", "managed switch", "managed_switch", "unmanaged switch", "unmanaged_switch")
SWITCH_RULE_OT_TYPES = (
    "plc", "rtu", "hmi", "historian", "scada", "ied", "controller",
    "sensor", "actuator", "drive", "vfd", "dcs",
)

# --- fixed values: function codes --------------------------------------------
MODBUS_WRITE_CODES = (5, 6, 15, 16)
MODBUS_WRITE_CODES_WIDE = (5, 6, 15, 16, 22, 23)
MODBUS_READ_CODES = (1, 2, 3, 4)
MODBUS_MASTER_CODES = (1, 2, 3, 4, 5, 6, 15, 16)
DNP3_WRITE_CODES = (2, 3, 4, 5, 6)
DNP3_MASTER_CODES = (1, 2, 3, 4, 5, 6)
MODBUS_FUNCTION_NAMES = {
    1: "Read Coils", 2: "Read Discrete Inputs", 3: "Read Holding Registers",
    4: "Read Input Registers", 5: "Write Single Coil", 6: "Write Single Register",
    7: "Read Exception Status", 8: "Diagnostics", 11: "Get Comm Event Counter",
    12: "Get Comm Event Log", 15: "Write Multiple Coils", 16: "Write Multiple Registers",
    17: "Report Server ID", 20: "Read File Record", 21: "Write File Record",
    22: "Mask Write Register", 23: "Read/Write Multiple Registers", 24: "Read FIFO Queue",
    43: "Read Device Identification",
}
DNP3_FUNCTION_NAMES = {
    0: "Confirm", 1: "Read", 2: "Write", 3: "Select", 4: "Operate", 5: "Direct Operate",
    6: "Direct Operate No Ack", 7: "Immediate Freeze", 8: "Immediate Freeze No Ack",
    9: "Freeze and Clear", 10: "Freeze and Clear No Ack", 11: "Freeze At Time",
    12: "Freeze At Time No Ack", 13: "Cold Restart", 14: "Warm Restart", 15: "Initialize Data",
    16: "Initialize Application", 17: "Start Application", 18: "Stop Application",
    20: "Enable Unsolicited", 21: "Disable Unsolicited", 22: "Assign Class",
    23: "Delay Measurement", 24: "Record Current Time", 25: "Open File", 26: "Close File",
    27: "Delete File", 28: "Get File Info", 29: "Authenticate File", 30: "Abort File",
    129: "Response", 130: "Unsolicited Response",
}
S7_FUNCTIONS = {
    0x04: "read_var", 0x05: "write_var", 0xF0: "setup_communication", 0x28: "pi_service",
    0x29: "plc_stop", 0x1A: "upload_start", 0x1B: "upload", 0x1C: "upload_end",
    0x1D: "download_start", 0x1E: "download", 0x1F: "download_end",
}
S7_TRANSFER_FUNCTIONS = (
    "upload", "download", "start_upload", "end_upload",
    "upload_start", "upload_end",
)
ENIP_COMMANDS = {
    0x0000: "nop", 0x0004: "list_services", 0x0063: "list_identity", 0x0064: "list_interfaces",
    0x0065: "register_session", 0x0066: "unregister_session", 0x006F: "send_rr_data",
    0x0070: "send_unit_data",
}
IEC104_RESET_TYPE = 105
IEC104_INTERROGATION_TYPE = 100

# --- fixed values: severities -------------------------------------------------
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
CRITICALITY_RANK = {"unknown": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
SECURITY_LEVEL_WEIGHT = {"sl1": 1.0, "sl2": 2.0, "sl3": 3.0, "sl4": 4.0}

# --- fixed values: remediation advice by technique, then by title --------------
ADVICE_BY_TECHNIQUE = {
    "T0855": "Restrict write access to authorized masters",
    "T0886": "Segment Purdue levels with firewalls or a DMZ",
    "T0843": "Protect and authenticate program downloads",
    "T0816": "Allow stop commands from engineering workstations only",
    "T0836": "Verify firmware and control its changes",
    "T0846": "Block the unauthorized device from the OT network",
    "T0814": "Allow diagnostics from engineering workstations only",
    "T0856": "Configure the list of authorized masters",
    "T0811": "Block communication control from unauthorized hosts",
}
ADVICE_BY_TITLE = (
    ("flat network", "Segment the network"),
    ("cleartext", "Evaluate encrypted protocol alternatives"),
    ("unencrypted", "Evaluate encrypted protocol alternatives"),
    ("internet", "Remove the public address or place the device behind a DMZ"),
    ("public ip", "Remove the public address or place the device behind a DMZ"),
)
# What a finding of each technique means, in our words; others go by the type of finding.
MEANING_BY_TECHNIQUE = {
    "T0800": "Firmware or program transfer reached field devices, which can put them in update mode",
    "T0801": "One host reads the state of very many process endpoints",
    "T0802": "One host collects data from many control devices",
    "T0803": "A field device has traffic but gets no commands, which may be blocked",
    "T0804": "An outstation that has a master sends no reports, which may be blocked",
    "T0806": "Writes to one device come at a rate of brute force",
    "T0809": "A program service that can delete blocks was called",
    "T0811": "A device was told to stop or restart its communication",
    "T0814": "Diagnostic or interrogation commands can keep a device from its work",
    "T0816": "A device was told to stop, restart or reset its process",
    "T0822": "A control device uses remote access services",
    "T0830": "One address was seen with several hardware addresses, as in the middle of a connection",
    "T0836": "Files of a device that hold its firmware or settings were used",
    "T0840": "One host probes many ports or hosts of control services",
    "T0843": "A program was sent to a controller",
    "T0845": "A program was read from a controller",
    "T0846": "A host that is no control device looks for control devices, or one is reachable from outside",
    "T0849": "Office traffic runs on a port of a control protocol",
    "T0855": "Commands that change the process were sent",
    "T0856": "Reports or alarms are forged or switched off",
    "T0861": "One host reads many points or units of a device",
    "T0864": "A device was on the control network only for a short time",
    "T0866": "A host from outside uses services through which a control device can be exploited",
    "T0867": "Files are moved to or from control devices",
    "T0868": "The operating mode of a controller can be changed by program transfer",
    "T0881": "A server of a control protocol gets far less traffic than others",
    "T0884": "A host passes control traffic on as client and server",
    "T0885": "A control protocol runs on a port that is not its own",
    "T0886": "Network zones reach each other that should be apart",
}
MEANING_BY_TYPE = {
    "attack_technique": "Traffic fits an attack technique", "purdue_violation": "Levels of the plant reach each other that should be apart",
    "anomaly": "Behaviour departs from what the device or protocol usually does",
}

ADVICE_DEFAULT = "Review the finding and apply vendor hardening guidance"

# --- fixed values: known vulnerabilities ---------------------------------------
CVES = (
    ("CVE-2020-28400", 7.5, "Siemens", ("SCALANCE X", "SCALANCE XR", "SCALANCE XB", "SCALANCE XC",
                                        "SCALANCE XF", "SCALANCE XM", "SCALANCE XP", "S7-1200"), "ICSA-21-194-03"),
    ("CVE-2023-44317", 7.2, "Siemens", ("SCALANCE X-200", "SCALANCE X-300"), "SSA-699386"),
    ("CVE-2022-46142", 6.5, "Siemens", ("SCALANCE X-200", "SCALANCE X-300", "SCALANCE XM400",
                                        "SCALANCE XR500"), "SSA-413565"),
    ("CVE-2021-37185", 7.5, "Siemens", ("Ruggedcom ROS",), "SSA-150692"),
    ("CVE-2022-30767", 9.8, "Moxa", ("EDS-400A", "EDS-500A"), "Moxa Security Advisory MPSA-221201"),
    ("CVE-2023-34260", 7.5, "Belden/Hirschmann", ("HiOS",), "BSECV-2023-17"),
    ("CVE-2021-27384", 9.8, "Belden/Hirschmann", ("Classic Platform",), "BSECV-2021-08"),
    ("CVE-2023-25072", 7.5, "Phoenix Contact", ("FL SWITCH", "FL MGUARD"), "VDE-2023-009"),
)

# --- fixed values: compliance requirements (framework, id, name, check) -----------
COMPLIANCE_REQUIREMENTS = (
    ("iec62443", "SR 5.1", "Network Segmentation", "flat_network"),
    ("iec62443", "SR 5.2", "Zone Boundary Protection", "purdue_violations"),
    ("iec62443", "SR 1.1", "Human User Identification and Authentication", "default_creds"),
    ("iec62443", "SR 4.1", "Information Confidentiality", "cleartext_ot"),
    ("iec62443", "SR 3.3", "Security Functionality Verification", "attack_findings"),
    ("iec62443", "FR 1", "Identification and Authentication", "device_inventory"),
    ("iec62443", "SR 5.1 (Purdue)", "Purdue Model Zone Assignment", "purdue_assigned"),
    ("iec62443", "SR 1.13", "Access via Untrusted Networks", "external_access"),
    ("iec62443", "SR 7.1", "Denial of Service Protection", "redundancy"),
    ("nist80082", "5.3.2", "Network Architecture", "flat_network"),
    ("nist80082", "5.3.3", "Remote Access", "external_access"),
    ("nist80082", "5.7.1", "Account Management", "default_creds"),
    ("nist80082", "5.4", "Data Security", "cleartext_ot"),
    ("nist80082", "4.3.1", "Asset Management", "device_inventory"),
    ("nist80082", "5.8", "Incident Response", "attack_findings"),
    ("nerccip", "CIP-002-5.1", "BES Cyber System Identification", "device_inventory"),
    ("nerccip", "CIP-005-7 R1", "Electronic Security Perimeter", "flat_network"),
    ("nerccip", "CIP-005-7 R2", "Remote Access Management", "external_access"),
    ("nerccip", "CIP-011-2", "Information Protection", "cleartext_ot"),
    ("nerccip", "CIP-007-6 R1", "Ports and Services", "internet_exposure"),
    ("nerccip", "CIP-007-6 R5", "System Access Controls", "default_creds"),
    ("nerccip", "CIP-010-4 R1", "Configuration Management", "attack_findings"),
)

# --- fixed values: vendor words of infrastructure devices ----------------------------
OT_SWITCH_VENDORS = (
    "hirschmann", "ruggedcom", "scalance", "moxa", "westermo", "phoenix contact", "belden",
    "cisco ie", "rockwell", "stratix", "perle", "korenix", "antaira", "red lion", "n-tron",
    "contemporary controls", "garrettcom", "datalogger", "prosoft",
)
FIREWALL_VENDORS = (
    "palo alto", "fortinet", "checkpoint", "cisco asa", "cisco ftd", "juniper srx", "sonicwall",
    "watchguard", "barracuda", "sophos", "forcepoint", "tufin", "ixia",
)
ROUTER_VENDORS = (
    "juniper", "mikrotik", "ubiquiti", "opnsense", "pfsense", "extreme networks",
    "hp networking", "aruba", "dell networking",
)
POLICY_TABLE_HEADER = ("Action", "Src Zone", "Src Net", "Dst Zone", "Dst Net", "Proto", "Port", "Dir", "Risk", "Justification")
VENDOR_PORT_NOTES = (
    ("siemens", 102, "S7comm PLC communication"),
    ("siemens", 443, "SCALANCE web management"),
    ("siemens", 161, "SCALANCE SNMP monitoring"),
    ("siemens", 34962, "PROFINET IO"),
    ("rockwell", 44818, "EtherNet/IP explicit messaging"),
    ("rockwell", 2222, "EtherNet/IP I/O"),
    ("schneider", 502, "Modbus TCP"),
    ("abb", 502, "Modbus TCP"),
    ("honeywell", 502, "Modbus TCP"),
)

# --- fixed values: zones by bucket (bucket, name, security level, levels) ------------
ZONES = (
    (1, "Control Zone", "sl3", (0, 1)),
    (2, "Supervisory Zone", "sl2", (2,)),
    (3, "Operations Zone", "sl2", (3,)),
    (35, "DMZ Zone", "sl2", (35,)),
    (4, "Enterprise Zone", "sl1", (4,)),
    (99, "Unclassified Zone", "sl1", ()),
)

# --- fixed values: live alert ports (ports, technique, title, severity) ----------------
LIVE_ALERT_PORTS = (
    ((3389, 5900, 5800), "T0822", "Remote Desktop Access to OT Device", "high"),
    ((445, 20, 21), "T0867", "Lateral Tool Transfer to OT Device", "high"),
    ((22, 23), "T0868", "Remote Service Access to OT Device", "medium"),
    ((80, 443, 8080, 8443), "T0885", "Web Management Access to OT Device", "medium"),
)
