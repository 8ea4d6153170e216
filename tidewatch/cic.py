"""CIC-IDS2017 instance of the data contract.

Fixed values: feature lists, labels, medians, ports and texts below must equal
the published ones for results to agree, so they are stated plainly.
"""

from __future__ import annotations

from tidewatch.spec import EvidencePolicy, FlowSpec, Rule

# Feature profiles, in contract order.
STRICT = (
    "Flow Duration", "Total Fwd Packets", "Total Length of Fwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean",
    "Fwd Packet Length Std", "Fwd Packets/s", "Fwd IAT Mean", "Fwd IAT Std",
    "Fwd IAT Max", "Fwd IAT Min", "Fwd Header Length", "Fwd PSH Flags",
    "act_data_pkt_fwd", "min_seg_size_forward", "Init_Win_bytes_forward",
    "Destination Port",
)
BIDIRECTIONAL = (
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Flow Bytes/s",
    "Flow Packets/s", "Fwd Packet Length Mean", "Bwd Packet Length Mean",
    "Flow IAT Mean", "Flow IAT Std", "SYN Flag Count", "ACK Flag Count",
    "Destination Port",
)

# Raw label -> class; None marks labels known but out of scope.
LABEL_MAP = {
    "BENIGN": "BENIGN", "DDoS": "DDoS", "PortScan": "PortScan", "Bot": "Botnet",
    "DoS Hulk": None, "DoS GoldenEye": None, "DoS slowloris": None,
    "DoS Slowhttptest": None, "Heartbleed": None, "FTP-Patator": None,
    "SSH-Patator": None, "Infiltration": None,
    # Latin-1 dash, hyphen and en dash occur.
    "Web Attack \x96 Brute Force": None,
    "Web Attack \x96 XSS": None,
    "Web Attack \x96 Sql Injection": None,
    "Web Attack - Brute Force": None,
    "Web Attack - XSS": None,
    "Web Attack - Sql Injection": None,
    "Web Attack \u2013 Brute Force": None,
    "Web Attack \u2013 XSS": None,
    "Web Attack \u2013 Sql Injection": None,
}

# IANA protocol number -> display name.
PROTOCOLS = {0: "OTHER", 1: "ICMP", 6: "TCP", 17: "UDP", 58: "ICMPv6"}

# Service ports with a name of their own.
WELL_KNOWN_PORTS = {
    20: "FTP-data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS",
    67: "DHCP", 80: "HTTP", 110: "POP3", 123: "NTP", 135: "MS-RPC", 139: "NetBIOS",
    143: "IMAP", 161: "SNMP", 389: "LDAP", 443: "HTTPS", 445: "SMB", 502: "Modbus",
    993: "IMAPS", 995: "POP3S", 1433: "MSSQL", 1521: "Oracle", 2404: "IEC-104",
    3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL", 5900: "VNC", 6379: "Redis",
    8080: "HTTP-alt", 8443: "HTTPS-alt", 20000: "DNP3",
}

# Column counts that identify the two published file layouts.
LAYOUTS = {85: "TrafficLabelling", 79: "MachineLearningCVE"}

CIC_SPEC = FlowSpec(
    name="cic",
    profiles={"STRICT_UNIDIRECTIONAL": STRICT, "BIDIRECTIONAL": BIDIRECTIONAL},
    default_profile="STRICT_UNIDIRECTIONAL",
    label_column="Label",
    label_map=LABEL_MAP,
    classes=("BENIGN", "DDoS", "PortScan", "Botnet"),
    identity=("Flow ID", "Source IP", "Source Port", "Destination IP", "Protocol", "Timestamp"),
    evidence_extras=("Flow Packets/s", "Flow Bytes/s", "Total Backward Packets",
                     "SYN Flag Count", "ACK Flag Count", "PSH Flag Count",
                     "Average Packet Size"),
    timestamp_column="Timestamp",
)


# Published per-class medians.
MEDIANS = {
    "Fwd Packets/s": {"BENIGN": 39.6, "Botnet": 57.7, "DDoS": 1.7, "PortScan": 20000.0},
    "Flow Packets/s": {"BENIGN": 76.1, "Botnet": 100.9, "DDoS": 2.7, "PortScan": 40000.0},
    "Fwd Packet Length Mean": {"BENIGN": 39.0, "Botnet": 6.0, "DDoS": 7.0, "PortScan": 0.0},
    "Fwd Packet Length Max": {"BENIGN": 42.0, "Botnet": 6.0, "DDoS": 20.0, "PortScan": 0.0},
    "Total Fwd Packets": {"BENIGN": 2.0, "Botnet": 3.0, "DDoS": 4.0, "PortScan": 1.0},
    "Total Length of Fwd Packets": {"BENIGN": 70.0, "Botnet": 6.0, "DDoS": 26.0, "PortScan": 0.0},
    "Flow Duration": {"BENIGN": 48699.0, "Botnet": 71053.0, "DDoS": 1876595.0, "PortScan": 50.0},
    "Fwd IAT Mean": {"BENIGN": 4.0, "Botnet": 23062.7, "DDoS": 482246.8, "PortScan": 0.0},
    "Fwd IAT Std": {"BENIGN": 0.0, "Botnet": 1653.2, "DDoS": 908248.3, "PortScan": 0.0},
    "Init_Win_bytes_forward": {"BENIGN": 122.0, "Botnet": 8192.0, "DDoS": 256.0, "PortScan": 29200.0},
    "act_data_pkt_fwd": {"BENIGN": 1.0, "Botnet": 0.0, "DDoS": 3.0, "PortScan": 0.0},
    "min_seg_size_forward": {"BENIGN": 20.0, "Botnet": 20.0, "DDoS": 20.0, "PortScan": 32.0},
    "Fwd Header Length": {"BENIGN": 64.0, "Botnet": 92.0, "DDoS": 80.0, "PortScan": 40.0},
    "Destination Port": {"BENIGN": 80.0, "Botnet": 8080.0, "DDoS": 80.0, "PortScan": 3527.0},
}

# Display units.
UNITS = {
    "Flow Duration": "microseconds",
    "Fwd IAT Mean": "microseconds",
    "Fwd IAT Std": "microseconds",
    "Fwd IAT Max": "microseconds",
    "Fwd IAT Min": "microseconds",
    "Fwd Packets/s": "packets/sec",
    "Flow Packets/s": "packets/sec",
    "Flow Bytes/s": "bytes/sec",
    "Fwd Packet Length Mean": "bytes",
    "Fwd Packet Length Max": "bytes",
    "Fwd Packet Length Min": "bytes",
    "Fwd Packet Length Std": "bytes",
    "Total Length of Fwd Packets": "bytes",
    "Fwd Header Length": "bytes",
    "Init_Win_bytes_forward": "bytes",
    "min_seg_size_forward": "bytes",
    "Average Packet Size": "bytes",
}

# Evidence rules per class. Feature and direction decide results;
# the wording of the explanation is ours.
RULES = {
    "PortScan": (
        Rule("Fwd Packet Length Mean", "low", "Packets carry next to no payload, as probes do."),
        Rule("Flow Duration", "low", "The flow ends as soon as the port has answered."),
        Rule("Fwd Packets/s", "high", "Packets leave far faster than usual here, as in automated sweeps."),
        Rule("Total Fwd Packets", "low", "Only a few packets were sent: a probe, no session."),
        Rule("Init_Win_bytes_forward", "near", "The initial TCP window is the one scan tools use."),
        Rule("Destination Port", "nonstandard", "No standard service listens on the targeted port."),
    ),
    "DDoS": (
        Rule("Fwd Packet Length Mean", "near", "Payload size is that of the flood's identical requests."),
        Rule("Flow Duration", "high", "The connection is held open far longer than usual here."),
        Rule("Fwd IAT Std", "high", "Gaps between packets vary widely, as when a connection is kept alive."),
        Rule("Init_Win_bytes_forward", "near", "The initial TCP window is the flood client's."),
        Rule("Total Length of Fwd Packets", "low", "Few bytes were sent for so long a connection."),
    ),
    "Botnet": (
        Rule("Init_Win_bytes_forward", "near", "The initial TCP window is that of the implant's stack."),
        Rule("Destination Port", "near", "The target is the fixed port this botnet's controller uses."),
        Rule("Fwd IAT Std", "low", "Gaps between packets hardly vary: a regular beacon."),
        Rule("act_data_pkt_fwd", "low", "Hardly any packet carries payload: a check-in."),
        Rule("Fwd Packet Length Mean", "low", "Payloads are as small as status messages."),
    ),
    "BENIGN": (
        Rule("Fwd Packet Length Mean", "near", "Payload size is normal for this network."),
        Rule("Flow Duration", "near", "Duration is normal for this network."),
        Rule("Fwd Packets/s", "near", "Packet rate is that of ordinary applications."),
    ),
}

NOTES = {
    "DDoS": "A flood shows in the aggregate; single flows look slow and ordinary.",
    "PortScan": "Scan breadth shows across many flows; single flows are judged alone here.",
    "Botnet": "Beaconing shows across a sequence of flows; single flows are judged alone here.",
}

CIC_EVIDENCE = EvidencePolicy(
    rules=RULES, medians=MEDIANS, units=UNITS, aggregate_notes=NOTES,
    port_features=("Destination Port",), duration_features=("Flow Duration",),
    well_known_ports=WELL_KNOWN_PORTS,
)
