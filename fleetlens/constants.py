"""Fixed values the results depend on: command names, word lists, patterns and formats.

Everything in this module is a fixed value that must match what hosts print or
what users of the tables expect, so it is stated here as plain text.
"""

# Line terminators that end a line of a snapshot (str.splitlines() semantics).
ODD_LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

# A header line such as "*****HOST INFO*****".
SECTION_HEADER = r"\*{5,}.+?\*{5,}[ \t]*"
INITIAL_SECTION = "PREAMBLE"
PARSER_VERSION = "1.0.0"

# Snapshot file names: <ip>_YYYYMMDD_HH:MM:SSZ.txt
SNAPSHOT_NAME = r"([^/_]+)_(\d{8}_\d{2}:\d{2}:\d{2}Z)\.txt$"
SNAPSHOT_TIME_FORMAT = "yyyyMMdd_HH:mm:ss'Z'"
SNAPSHOT_GLOB = "*_20??????_*Z.txt"

# Command line -> stable tag.
COMMAND_TAGS = [
    ("hostnamectl", "hostnamectl"),
    ("uname -a", "uname_a"),
    ("cat /etc/*release*", "etc_release"),
    ("cat /proc/cmdline", "proc_cmdline"),
    ("domainname", "domainname"),
    ("timedatectl", "timedatectl"),
    ("uptime", "uptime"),
    ("free -h", "free_h"),
    ("lsblk -a", "lsblk_a"),
    ("df -B1", "df_B1"),
    ("dmidecode", "dmidecode"),
    ("lshw -disable dmi", "lshw_disable_dmi"),
    ("lspci -v", "lspci_v"),
    ("lsusb -v", "lsusb_v"),
    (
        "sysctl kernel.kptr_restrict kernel.dmesg_restrict kernel.unprivileged_bpf_disabled "
        "fs.protected_hardlinks fs.protected_symlinks fs.protected_fifos fs.protected_regular "
        "net.ipv4.ip_forward net.ipv4.conf.all.rp_filter net.ipv4.conf.default.rp_filter "
        "net.ipv6.conf.all.disable_ipv6 net.ipv6.conf.default.disable_ipv6",
        "sysctl_hardening",
    ),
    ("mokutil --sb-state", "mokutil_sb_state"),
    ("who -a", "who_a"),
    ("w", "w"),
    ("tty", "tty"),
    ("lastlog | sort", "lastlog"),
    ("last -f /var/log/wtmp", "last_wtmp"),
    ("last -f /var/log/btmp", "last_btmp"),
    ("last -f /var/run/utmp", "last_utmp"),
    ('journalctl -u ssh -u sshd --since "7 days ago" --no-pager', "journalctl_ssh_7d"),
    ("tail -n 200 /var/log/auth.log", "tail_auth_log"),
    ("tail -n 200 /var/log/secure", "tail_secure"),
    ("ssh-keygen -lf /etc/ssh/ssh_host_*_key.pub", "ssh_hostkey_fps"),
    ("auditctl -s", "auditctl_s"),
    ("auditctl -l", "auditctl_l"),
    ("sestatus", "sestatus"),
    ("getsebool -a", "getsebool_a"),
    ("aa-status", "aa_status"),
    ("route -n", "route_n"),
    ("cat /etc/resolv.conf", "resolv_conf"),
    ("ip neigh", "ip_neigh"),
    ("nmcli", "nmcli"),
    ("nft list ruleset", "nft_ruleset"),
    ("ps -elf --sort pid", "ps_elf"),
    ("pstree", "pstree"),
    ("lsmod | sort", "lsmod"),
    ("cat /etc/crontab", "etc_crontab"),
    ("ls -latR /etc/cron.*", "ls_etc_cron"),
    ("ls -latR /etc/cron*", "ls_etc_cron"),
    ("ls -latR /var/spool/cron", "ls_var_spool_cron"),
    ("ls -latR /etc/systemd/system", "ls_etc_systemd_system"),
    ("ls -latR /etc/init.d", "ls_etc_init_d"),
    ("ls -latR /etc/init/*", "ls_etc_init"),
    ("ls -latR /etc/rc.d", "ls_etc_rc_d"),
    ("cat /etc/ld.so.preload", "ld_so_preload"),
    ("find /bin /sbin /usr/{bin,sbin} /usr/local/{bin,sbin} -maxdepth 1 -mtime 180 | xargs -r ls -l", "recent_bins"),
    ("find /bin /sbin /usr/{bin,sbin} /usr/local/{bin,sbin} -maxdepth 1 -mtime 180 -exec ls -l {} +", "recent_bins"),
    ("getcap -r /", "getcap_r"),
    ("getcap -r /bin /sbin /usr/bin /usr/sbin /usr/local/bin /usr/local/sbin /opt 2>/dev/null", "getcap_r"),
    ("getcap -r /etc /root 2>/dev/null", "getcap_r"),
    ("cat /root/.bash_history", "root_bash_history"),
    ("printenv", "printenv"),
    ("set", "shell_set"),
    ("cat /etc/passwd", "etc_passwd"),
    ("cat /etc/group", "etc_group"),
    ("getent group sudo root wheel adm admin", "priv_groups"),
    ("cut -d':' -f1 < /etc/passwd | xargs -I {} passwd -S {}", "passwd_status"),
    ("ip a", "ip_addr"),
    ("ss -punt", "ss_punt"),
    ("systemctl list-units -all --full", "systemctl_units"),
    ("systemctl list-timers --all", "systemctl_timers"),
    ("systemctl list-unit-files --state=enabled", "systemctl_enabled_unit_files"),
    ("dpkg -l | sort", "dpkg_list"),
    ("rpm -q --all | sort", "rpm_all"),
    ("iptables -S", "iptables_s"),
    ("iptables -L -n -v", "iptables_list"),
    ("ufw status verbose", "ufw_status"),
    ("ufw show raw", "ufw_raw"),
    ("firewall-cmd --list-all-zones", "firewalld_zones"),
    ("cat /root/.ssh/authorized_keys", "root_authorized_keys"),
    ("sshd -T", "sshd_T"),
    ("cat /etc/ssh/sshd_config", "sshd_config"),
    ("ls -la /etc/ssh/sshd_config.d", "sshd_config_d_ls"),
    ("cat /etc/ssh/sshd_config.d/*", "sshd_config_d_cat"),
    ("cat /etc/sudoers", "sudoers"),
    ("ls -la /etc/sudoers.d", "sudoers_d_ls"),
    ("cat /etc/sudoers.d/*", "sudoers_d_cat"),
    ("cat /etc/rsyslog.conf", "rsyslog_conf"),
    ("cat /etc/systemd/journald.conf", "journald_conf"),
    ("cat /etc/ntp.conf", "ntp_conf"),
    ("cat /etc/chrony.conf", "chrony_conf"),
    ("cat /etc/systemd/timesyncd.conf", "timesyncd_conf"),
    ("cat /etc/chrony/chrony.conf", "chrony_conf"),
    ("cat /etc/login.defs", "login_defs"),
    ("docker ps -a", "docker_ps_a"),
    ("docker info", "docker_info"),
    ("podman ps -a", "podman_ps_a"),
    ("podman info", "podman_info"),
]

# Loop blocks are recognised by how they start (and a word they contain).
LOOP_COMMAND_TAGS = [
    ('for u in $users; do echo "# cat /home/$u/.ssh/authorized_keys"', "", "home_authorized_keys"),
    ('for u in $users; do echo "# cat /home/$u/.ssh/known_hosts"', "", "home_known_hosts"),
    ("for m in $mods; do", "modinfo", "modinfo_all"),
]
# A longer slug keeps so many characters and gets a hash of the whole.
SLUG_LENGTH = 96
SENSITIVE_TAGS = ["root_bash_history", "printenv"]

# Human size suffixes, base 1024.
SIZE_UNITS = {"k": 1, "m": 2, "g": 3, "t": 4, "p": 5}

# Timestamp formats by the shape of the text, in the order they are tried; weekday
# names are removed first. Seconds are optional everywhere.
TIME_FORMATS = [
    (r"^\d{4}-\d+-\d+ ", ["yyyy-M-d H:m[:s]"]),
    (r"^\d{4}-\d+-\d+T", ["yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:sXXX", "yyyy-M-d'T'H:m:sXX"]),
    (r"^[A-Za-z]{3} \d+ [\d:]+ \d{4}$", ["MMM d H:m[:s] yyyy"]),
    (r"^\d+/\d+/\d{4} ", ["M/d/yyyy H:m[:s]", "d/M/yyyy H:m[:s]"]),
    (r"^\d+/\d+/\d{2} ", ["M/d/yy H:m[:s]"]),
    (r"^\d+-\d+-\d{4} ", ["d-M-yyyy H:m[:s]"]),
]
YEARLESS_SHAPE = r"^[A-Za-z]{3} \d+ [\d:]+$"
YEARLESS_FORMAT = "MMM d H:m[:s]"

# Group names that belong to the system.
WELL_KNOWN_GROUPS = [
    "root", "bin", "daemon", "sys", "adm", "tty", "disk", "lp", "mem", "kmem", "wheel",
    "mail", "uucp", "man", "dbus", "nobody", "nogroup", "messagebus", "polkitd", "rtkit",
    "systemd-journal", "systemd-timesync", "systemd-network", "systemd-resolve", "systemd-bus-proxy",
    "input", "kvm", "render", "crontab", "sasl", "ssh", "colord", "avahi", "usbmux", "geoclue",
    "pulse", "pulse-access", "gdm", "sddm", "lpadmin", "sambashare", "docker", "libvirt",
    "nopasswdlogin", "sudo", "cdrom", "dialout", "dip", "plugdev", "staff", "users", "video",
    "bluetooth", "netdev", "libvirt-dnsmasq", "libvirt-qemu",
]
ADMIN_GROUPS = ["sudo", "wheel", "adm", "admin", "root"]
EXPECTED_SHELL_ACCOUNTS = ["root", "ubuntu", "ec2-user"]

UNIT_TYPES = ["service", "socket", "timer", "path", "mount", "target", "slice", "scope"]

USB_CLASS_LABELS = {
    0x00: "Device", 0x01: "Audio", 0x02: "CDC", 0x03: "HID", 0x05: "Physical",
    0x06: "Image", 0x07: "Printer", 0x08: "Mass Storage", 0x09: "Hub", 0x0A: "CDC-Data",
    0x0B: "Smart Card", 0x0D: "Content Security", 0x0E: "Video", 0x0F: "Healthcare",
    0x10: "Audio/Video", 0xDC: "Diagnostic", 0xE0: "Wireless", 0xEF: "Misc",
    0xFE: "Application", 0xFF: "Vendor",
}
USB_VENDOR_DRIVERS = {
    "1d6b": "usbcore", "8086": "iwlwifi", "8087": "iwlwifi", "0bda": "rtl8xxxu", "0e8d": "mt76x2u",
}

DMI_PLACEHOLDERS = [
    "to be filled by o.e.m.", "to be filled by oem", "o.e.m.", "oem", "default string",
    "system product name", "system serial number", "system manufacturer", "system version",
    "base board product", "chassis serial number", "not specified", "none", "n/a", "",
]
GPU_VENDORS = ["NVIDIA Corporation", "Intel Corporation", "Advanced Micro Devices"]

# Interface name prefixes.
VIRTUAL_IFACES = ["virbr", "vnet", "vb", "tap", "tun"]
PHYSICAL_IFACES = ["eno", "enp", "ens", "eth", "wlan", "wlp", "wl", "usb", "ib"]

FAKE_HARDWARE_IDS = r"^(?:0+$|123456789|00000000|[f-]+$|none$|null$|n/a$|unknown$)"
IDENTIFIER_SCORES = {"primary_mac": 100, "dmi_uuid": 90, "hostname": 80, "machine_id": 0, "serial_number": 40}

MODINFO_FIELDS = [
    "license", "signer", "sig_id", "description", "author", "vermagic",
    "filename", "firmware", "alias", "depends", "retpoline", "intree",
]
COMMON_MODULES = [
    "nf_conntrack", "iptable_filter", "iptable_nat", "xt_conntrack", "nf_nat",
    "bridge", "stp", "llc", "ebtable_filter", "ebtables", "ip_tables", "x_tables",
    "ipv6", "crc32c_intel", "aesni_intel", "cryptd", "ghash_clmulni_intel",
    "pcbc", "lrw", "gf128mul", "ablk_helper", "xts", "sha256_ssse3", "sha512_ssse3",
    "i2c_piix4", "i2c_core", "button", "video", "wmi", "pcc_cpufreq", "acpi_cpufreq",
    "mperf", "kvm_intel", "kvm", "snd_hda_intel", "snd_hda_codec", "snd_hwdep",
    "snd_pcm", "snd_timer", "snd", "soundcore", "i915", "drm_kms_helper", "drm",
    "fb_sys_fops", "syscopyarea", "sysfillrect", "sysimgblt", "ahci", "libahci",
    "sd_mod", "sr_mod", "cdrom", "ata_piix", "ata_generic", "pata_acpi", "e1000e",
    "uhci_hcd", "ehci_hcd", "xhci_hcd", "usbcore", "usb_common", "hid", "hid_generic",
]
SUSPICIOUS_LICENSES = ["Proprietary", "Unknown", "Binary-only"]
UNTRUSTED_SIGNERS = ["unknown", "unsigned"]

LISTING_SOURCES = {
    "ls_etc_cron": "cron_dirs",
    "ls_var_spool_cron": "cron_dirs",
    "ls_etc_systemd_system": "systemd_dirs",
    "ls_etc_init_d": "init_dirs",
    "ls_etc_init": "init_dirs",
    "ls_etc_rc_d": "init_dirs",
    "recent_bins": "recent_bins",
}
COMMON_SYSTEMD_UNITS = [
    "systemd-networkd.service", "systemd-resolved.service", "sshd.service",
    "cron.service", "rsyslog.service", "systemd-journald.service",
    "NetworkManager.service", "dbus.service", "systemd-logind.service",
    "systemd-timesyncd.service", "ufw.service", "apparmor.service",
    "auditd.service", "irqbalance.service", "unattended-upgrades.service",
]
EXPECTED_CRON_DIRS = ["/etc/cron.d", "/etc/cron.daily", "/etc/cron.hourly", "/etc/cron.monthly", "/etc/cron.weekly"]

DOCKER_INFO_KEYS = [
    "Server Version", "Operating System", "Kernel Version", "Cgroup Driver", "Cgroup Version",
    "Storage Driver", "Logging Driver", "Security Options", "Root Dir", "Docker Root Dir",
    "Containers", "Containers Paused", "Containers Running", "Images", "Runtimes", "Default Runtime",
]
PODMAN_INFO_KEYS = [
    "host", "version", "store", "registries", "plugins", "os", "arch", "cpus", "memTotal",
    "graphDriverName", "rootless",
]
SSHD_FACT_KEYS = ["passwordauthentication", "permitrootlogin", "pubkeyauthentication", "allowusers", "allowgroups"]
BOOT_FACT_KEYS = ["audit", "selinux", "enforcing", "lockdown"]

FIREWALL_TYPES = [
    ("iptables_s", "iptables save-style rules (-S)"),
    ("iptables_list", "iptables list (-L -n -v)"),
    ("ufw_raw", "UFW raw iptables rules"),
    ("firewalld_zones", "firewalld zone configuration"),
]

AUTH_LOG_SOURCES = {"journalctl_ssh_7d": "journalctl_ssh", "tail_auth_log": "auth_log", "tail_secure": "secure"}
AUTH_LOG_PHRASES = {
    "failed_password_count": "failed password",
    "invalid_user_count": "invalid user",
    "accepted_password_count": "accepted password",
    "accepted_publickey_count": "accepted publickey",
    "sudo_count": "sudo",
    "error_count": "error",
}

# Audit rule words per flag: syscalls, path fragments, keys.
AUDIT_FLAG_WORDS = {
    "has_critical_auth_rules": (
        ["execve", "clone", "fork", "vfork"],
        ["/bin/su", "/usr/bin/sudo"],
        ["auth", "authentication", "login", "session"],
    ),
    "has_critical_file_rules": (
        [],
        ["/etc/passwd", "/etc/shadow", "/etc/sudoers"],
        ["file_integrity", "config_change"],
    ),
    "has_critical_process_rules": (
        ["execve", "clone", "fork"],
        ["/bin/", "/sbin/", "/usr/bin/", "/usr/sbin/"],
        ["process", "execution", "binary"],
    ),
    "has_time_change_rules": (["settimeofday", "stime", "clock_settime"], [], ["time", "clock"]),
    "has_sudo_rules": ([], ["/usr/bin/sudo"], ["sudo"]),
    "has_passwd_rules": ([], ["/etc/passwd", "/etc/shadow", "/usr/bin/passwd"], ["passwd", "password"]),
}
EXECUTABLE_DIRS = ["/bin/", "/sbin/", "/usr/bin/", "/usr/sbin/"]

HIGH_RISK_BOOLEANS = [
    "allow_execheap", "allow_execmem", "allow_execstack", "allow_ptrace_all_unconfined",
    "deny_execmem", "deny_ptrace", "secure_mode_insmod", "ssh_sysadm_login",
]
INTERNAL_DNS_MARKERS = [".local", ".internal", "localhost"]
SUSPICIOUS_NETWORKS = ["127.0.0.0", "169.254.0.0"]
SUSPICIOUS_OUIS = {"00:00:00": "Null OUI", "ff:ff:ff": "Broadcast OUI"}

KNOWN_PORTS = [22, 80, 443, 53, 25, 110, 143, 993, 995, 3306, 5432, 6379, 27017, 2049, 111]
SUSPICIOUS_ROOT_COMMANDS = [
    r"nc\s.*-e",
    r"ncat\s.*-e",
    r"bash\s.*-i",
    r"sh\s.*-i",
    r"python.*-c.*import",
    r"perl.*-e",
    r"wget.*\|.*bash",
    r"curl.*\|.*bash",
    r"base64.*-d.*\|.*bash",
]

# Columns of the expected-inventory CSV, misspellings included.
INVENTORY_TEXT = [
    "hostname", "domain", "fqdn", "classification", "location",
    "server_manufacturer", "server_model_series", "server_model_no",
    "proc_manufacturer", "proc_model_series", "proc_model_no",
]
INVENTORY_COLUMNS = INVENTORY_TEXT + [
    "proc_no_cores", "proc_count", "gpu_manufacturer", "gpu_model_series", "gpu_model_no", "gpu_count",
    "memory_capacity_gb", "storage_hdd_no_drives", "storage_hdd_capacity_gb",
    "storage_nvme_no_drives", "storage_nvme_capabity_gb", "storage_ssd_no_drives", "storage_ssd_capabity_gb",
    "os_name", "os_version", "arch", "primary_ip", "interface", "mac_addr",
]
INVENTORY_INTS = ["proc_no_cores", "proc_count", "gpu_count",
                  "storage_hdd_no_drives", "storage_nvme_no_drives", "storage_ssd_no_drives"]
INVENTORY_DOUBLES = ["memory_capacity_gb", "storage_hdd_capacity_gb",
                     "storage_nvme_capabity_gb", "storage_ssd_capabity_gb"]

SEVERITY_ORDER = ["critical", "high", "medium", "low", "info"]
HIDDEN_MOUNTS = ["/proc", "/sys", "/dev", "/run", "/tmp"]
SYSTEM_COMMAND_DIRS = ["/usr/bin/", "/bin/", "/sbin/"]
