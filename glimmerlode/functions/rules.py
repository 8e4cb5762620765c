"""Rule data. Fixed values that results depend on; they stand here as plain text, in their natural order."""

# Weight of each API name.
API_WEIGHTS = {
    "VirtualAlloc": 25, "VirtualAllocEx": 30, "VirtualProtect": 18, "VirtualProtectEx": 20, "WriteProcessMemory": 35, "CreateRemoteThread": 40, "CreateRemoteThreadEx": 40, "NtWriteVirtualMemory": 35, "NtCreateThreadEx": 40,
    "SetWindowsHookExW": 20, "SetWindowsHookExA": 20, "WinExec": 10, "ShellExecuteW": 4, "ShellExecuteA": 4, "CreateProcessW": 8, "CreateProcessA": 8, "URLDownloadToFileW": 20, "URLDownloadToFileA": 20, "InternetOpenUrlW": 15, "InternetOpenUrlA": 15,
    "InternetReadFile": 15, "WinHttpOpen": 15, "WinHttpConnect": 15, "WinHttpSendRequest": 15, "socket": 10, "connect": 15, "recv": 10, "send": 10, "WSAStartup": 5, "CryptEncrypt": 20, "CryptDecrypt": 20, "BCryptEncrypt": 20, "BCryptDecrypt": 20,
    "RegSetValueExW": 5, "RegSetValueExA": 5, "RegCreateKeyExW": 5, "RegCreateKeyExA": 5, "CreateServiceW": 25, "CreateServiceA": 25, "StartServiceW": 20, "StartServiceA": 20, "OpenSCManagerW": 10, "OpenSCManagerA": 10,
    "IsDebuggerPresent": 3, "CheckRemoteDebuggerPresent": 8, "OutputDebugStringW": 1, "OutputDebugStringA": 1, "TerminateProcess": 5, "CreateFileW": 2, "CreateFileA": 2, "WriteFile": 2, "ReadFile": 2, "LoadLibraryW": 4, "LoadLibraryA": 4, "GetProcAddress": 3,
}
# Names whose A and W forms share a canonical name.
TWO_FORMS = ["CreateProcess", "ShellExecute", "URLDownloadToFile", "InternetOpenUrl", "RegSetValueEx", "RegCreateKeyEx", "CreateService", "StartService", "OpenSCManager", "OutputDebugString", "LoadLibrary", "CreateFile", "RegOpenKeyEx"]
# Capability -> APIs, least matches, base score.
CAPABILITIES = {
    "process_injection": (["VirtualAlloc", "VirtualAllocEx", "WriteProcessMemory", "CreateRemoteThread", "CreateRemoteThreadEx", "NtWriteVirtualMemory", "NtCreateThreadEx"], 2, 40),
    "networking": (["socket", "connect", "recv", "send", "WSAStartup", "WinHttpOpen", "WinHttpConnect", "WinHttpSendRequest", "InternetOpenUrlA", "InternetOpenUrlW", "InternetReadFile", "URLDownloadToFileA", "URLDownloadToFileW"], 2, 20),
    "crypto": (["CryptEncrypt", "CryptDecrypt", "BCryptEncrypt", "BCryptDecrypt"], 1, 20),
    "persistence": (["RegCreateKeyEx", "RegSetValueEx", "RegOpenKeyEx"], 3, 15),
    "anti_analysis": (["IsDebuggerPresent", "OutputDebugString", "CheckRemoteDebuggerPresent"], 3, 8),
    "dynamic_loading": (["LoadLibraryW", "LoadLibraryA", "GetProcAddress"], 2, 10),
}
# Capabilities by weight, and the names that prove injection.
SOFT = ["anti_analysis", "persistence", "dynamic_loading"]
HIGH_IMPACT = ["process_injection", "networking", "crypto"]
STRONG_INJECTION = ["VirtualAllocEx", "WriteProcessMemory", "CreateRemoteThread", "CreateRemoteThreadEx", "NtWriteVirtualMemory", "NtCreateThreadEx"]
# Pattern -> keywords, score, tag.
STRING_PATTERNS = {
    "url_or_network": (["http://", "https://", "ftp://", "www.", ".com", ".net", ".org", "user-agent", "host:", "cookie"], 15, "networking"),
    "filesystem_path": (["c:\\", "\\users\\", "\\appdata\\", "\\temp\\", "\\windows\\", ".exe", ".bat", ".cmd", ".ps1"], 10, "filesystem"),
    "registry": (["hkey_", "software\\microsoft\\windows\\currentversion\\run", "runonce", "regsvr32"], 20, "persistence"),
    "crypto_ransom": (["aes", "rsa", "encrypt", "decrypt", "ransom", "bitcoin", "wallet"], 12, "crypto"),
    "commands": (["cmd.exe", "powershell", "rundll32", "wmic", "schtasks", "bitsadmin", "certutil"], 20, "execution"),
    "anti_analysis": (["sandbox", "debugger", "vmware", "virtualbox", "wireshark", "procmon", "ollydbg"], 20, "anti_analysis"),
}
# Marks of real network use, and words of vendors.
STRONG_NETWORK_MARKS = ["http://", "https://", "user-agent", "host:", "cookie"]
VENDOR_KEYWORDS = ["microsoft", "notepad", "richedit", "comdlg", "print", "page setup", "font", "open file", "save file"]
# Behaviour role -> API names, as they are probed.
ROLE_APIS = {
    "loader": ["LoadLibraryW", "LoadLibraryA", "GetProcAddress"],
    "network": ["socket", "connect", "recv", "send", "WSAStartup", "WinHttpOpen", "WinHttpConnect", "WinHttpSendRequest", "InternetOpenUrlA", "InternetOpenUrlW", "InternetReadFile", "URLDownloadToFileA", "URLDownloadToFileW"],
    "persistence": ["RegSetValueExW", "RegSetValueExA", "RegCreateKeyExW", "RegCreateKeyExA", "CreateServiceW", "CreateServiceA", "StartServiceW", "StartServiceA", "OpenSCManagerW", "OpenSCManagerA"],
    "anti_analysis": ["IsDebuggerPresent", "CheckRemoteDebuggerPresent", "OutputDebugStringW", "OutputDebugStringA"],
    "crypto": ["CryptEncrypt", "CryptDecrypt", "BCryptEncrypt", "BCryptDecrypt"],
    "execution": ["CreateProcessW", "CreateProcessA", "WinExec", "ShellExecuteW", "ShellExecuteA"],
    "injection": ["VirtualAlloc", "VirtualAllocEx", "WriteProcessMemory", "CreateRemoteThread", "CreateRemoteThreadEx", "NtWriteVirtualMemory", "NtCreateThreadEx"],
}
# Section names, suspicious, of code, common.
SUSPICIOUS_SECTIONS = ["UPX0", "UPX1", "UPX2", ".aspack", ".adata", ".packed", ".petite", ".boom", ".stub", ".themida", ".vmp0", ".vmp1", ".vmp2"]
CODE_SECTIONS = [".text", "text", ".code", "code"]
COMMON_SECTIONS = [".text", ".rdata", ".data", ".rsrc", ".idata", ".reloc", "text", ".code", "code"]
# Benign context -> adjustment.
BENIGN_CONTEXTS = {"rich_windows_gui_context": -35, "benign_dynamic_loading_context": -20, "desktop_app_file_io_context": -12, "weak_persistence_signal": -18, "weak_anti_analysis_signal": -15, "no_high_risk_functions": -15, "benign_string_context": -10, "microsoft_desktop_app_profile": -25, "soft_capability_only_profile": -15}
# Named score condition -> delta.
SCORE_RULES = {"multiple_high_risk_top_functions": 10, "packed_sample_static_visibility_penalty": -10, "process_injection_capability": 15, "high_signal_interesting_strings": 5, "top_function_reasoned_evidence": 6, "strong_packing_with_weak_visible_behavior": -6, "benign_context_heavy_discount": -10, "soft_capability_only_discount": -8}

# Packer family hints that name no family.
NO_FAMILY = ["", "none", "unknown", "n/a", "na", "null"]
# Dominant risk -> interpretation, and the one of all others.
INTERPRETATIONS = {
    "low_signal": "both malware-oriented and packing-oriented signals remain weak under current static triage",
    "packing": "packing-oriented risk dominates, so the binary may require unpacking or deeper manual reversing before final judgement",
    "malware": "malware-oriented risk dominates, so the currently visible static indicators are already materially suspicious",
}
INTERPRETATION_ELSE = "malware and packing signals should be balanced against the benign context already visible in the raw report"
# Packer indicator -> points, of the file itself and of its entry code.
PACKER_INDICATORS = {"suspicious_sections": 20, "entrypoint_in_suspicious_section": 25, "entrypoint_in_rwx_section": 20, "very_small_import_surface": 15, "small_import_surface": 8, "runtime_unpacking_apis": 20, "nonstandard_executable_sections": 10, "high_entropy_sections": 12, "high_entropy_executable_sections": 18, "high_entropy_entrypoint_section": 15, "high_entropy_plus_small_import_surface": 10}
PACKER_ENTRY_INDICATORS = {"strong_oep_candidate": 15, "popad_backed_oep_transition": 10, "late_stub_handoff": 8}
# Section names that hold resources.
RESOURCE_SECTIONS = [".rsrc", "rsrc", "resource"]
# Roles of a path (all of them) -> note, in order; then the two notes for paths without such roles.
PATH_NOTES = [
    (["loader", "execution"], "possible loader-to-execution handoff"), (["injection"], "possible injection-oriented control path"), (["network", "persistence"], "possible network-and-persistence chain"),
    (["anti_analysis"], "analysis-aware stage present"), (["crypto"], "crypto-related processing stage present"),
]
PATH_DISPATCHER = "control likely fans out through dispatcher-like logic"
PATH_PLAIN = "control-flow relationship reconstructed without explicit behavioral role evidence"
# Capability -> behaviour, role pair -> behaviour, and the behaviour of three-hop flows, in order.
CAPABILITY_BEHAVIORS = {"process_injection": "possible process injection workflow", "networking": "network communication capability present", "persistence": "persistence-related activity present", "anti_analysis": "anti-analysis or debugger-awareness present", "crypto": "cryptographic functionality present"}
PAIR_BEHAVIORS = [(["loader", "execution"], "loader/execution chain likely present"), (["network", "persistence"], "network + persistence combination detected"), (["loader", "injection"], "dynamic loading plus injection primitives detected")]
FLOW_BEHAVIOR = "multi-stage internal control flow detected"
# Derived capability -> confidence and what it asks for.
DERIVED_RULES = [
    {"name": "in_memory_loader", "confidence": "high", "requires_all": ["process_injection", "dynamic_loading"], "requires_high_confidence": ["process_injection"], "min_high_risk_functions": 1},
    {"name": "persistent_networked_payload", "confidence": "medium", "requires_all": ["networking", "persistence"], "min_high_risk_functions": 1},
    {"name": "evasion_aware_injector", "confidence": "medium", "requires_all": ["anti_analysis", "process_injection"], "requires_high_confidence": ["process_injection"]},
    {"name": "packed_loader_stub", "confidence": "medium", "requires_any": ["dynamic_loading"], "require_likely_packed": True, "require_high_entropy_executable": True},
    {"name": "staged_injector", "confidence": "high", "requires_all": ["process_injection", "dynamic_loading"], "requires_high_confidence": ["process_injection"], "min_top_function_score": 30},
]


def canonical_name(api: str) -> str:
    """Base name of an A or W form; other names stay."""
    return api[:-1] if api[-1:] in "AW" and api[:-1] in TWO_FORMS else api


def canonical_apis(capability: str) -> list[str]:
    return sorted({canonical_name(a) for a in CAPABILITIES[capability][0]})
