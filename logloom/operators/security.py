"""Rule findings on text, their score, level and decision; all within the row, without a shuffle."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.grams import SIZE, is_set, may_contain
from logloom.functions.variants import bound

#: Rule, category, severity, patterns of which any is contained.
RULES = [
    ("credential.named_secret", "credential", "high", ["authorization:", "cookie:", "sessionid=", "auth_token=", "secret_key", "access_key", "database_url"]),
    ("credential.database_url", "credential", "high", ["mysql://", "postgres://", "postgresql://", "mongodb://", "redis://"]),
    ("credential.cloud_key", "credential", "high", ["akid", "ltai"]),
    ("tool.shell.command", "tool", "medium", ["curl ", "wget ", " nc ", "bash -c", "python -c", "powershell"]),
    ("tool.git_info", "tool", "low", ["git remote", "gh auth token", ".git/config"]),
    ("network.ip_probe", "network", "high", ["ifconfig.me", "ipinfo.io", "ip-api.com", "ipify.org", "icanhazip.com"]),
    ("network.suspicious_domain", "network", "medium", ["webhook.site", "requestbin", "ngrok", "pastebin.com", "transfer.sh"]),
    ("network.external_url", "network", "info", ["http://", "https://"]),
    ("network.tracking_pixel", "network", "high", ["1x1", "tracking", "pixel", "beacon"]),
    ("file.ssh_key", "file", "critical", ["id_rsa", "id_ed25519", "id_ecdsa"]),
    ("file.cloud_credentials", "file", "high", [".aws/credentials", ".npmrc", ".pypirc"]),
    ("infra.local_path", "infra", "medium", ["/users/", "c:\\users\\", "/home/"]),
]
#: Token prefix and least length in bytes of a secret.
SECRETS = [("sk-", 24), ("sk-ant-", 30), ("sk-proj-", 24), ("ghp_", 20), ("gho_", 20), ("xoxb-", 20), ("AKIA", 16), ("AIza", 20)]
#: A web token has this prefix, this length and a dot.
WEB_TOKEN = ("eyJ", 30)
#: What ends a token.
DELIMITERS = " \n\t\"':;,()`=<>"
PRIVATE_KEYS = ["-----BEGIN OPENSSH PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----"]
#: What reads sensitive files, what fetches, what runs a fetched script.
SENSITIVE = ["cat /etc/passwd", "cat /etc/shadow", "cat .env", "cat ~/.ssh", "printenv", "base64 ~/.ssh", "/etc/passwd", "/etc/shadow", ".ssh/id_rsa", ".aws/credentials"]
FETCH = ["curl ", "wget ", "http://", "https://"]
RUN = ["bash", "sh -c", "sh;", "sh &&"]
#: Rule, severity, code points as a regular expression class.
UNICODE = [
    ("unicode.zero_width", "medium", r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"),
    ("unicode.bidi_control", "high", r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"),
    ("unicode.variation_selector", "low", r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"),
    ("unicode.homograph", "medium", r"[\x{0400}-\x{04FF}\x{0370}-\x{03FF}]"),
]
#: What all of these lie in; one range is found faster than many.
UNUSUAL = r"[\x{0370}-\x{10FFFF}]"
#: Finding categories that a whitelist entry of each kind exempts (keyword: all).
EXEMPTS = {"domain": ["network"], "tool": ["tool"], "path": ["file", "infra"]}
#: Base score of each severity, in rising order.
BASE = {"clean": 0, "info": 5, "low": 15, "medium": 35, "high": 65, "critical": 90}
#: Title and description of each rule's findings.
SAID = {
    "credential.secret_token": ("发现疑似密钥/Token", "请求内容中出现 API Key、Bearer Token、GitHub Token、JWT 或云厂商密钥样式字符串。"),
    "credential.private_key": ("发现私钥内容", "请求内容中包含私钥 PEM/OpenSSH 头部，存在严重凭证泄露风险。"),
    "credential.named_secret": ("发现敏感凭证字段", "请求内容包含 Authorization、Cookie、Session 或 Secret 字段名。"),
    "credential.database_url": ("发现数据库连接串", "内容包含数据库连接串（mysql/postgres/mongodb/redis），存在凭证泄露风险。"),
    "credential.cloud_key": ("发现云厂商密钥", "内容包含腾讯云 SecretId 或阿里云 AccessKey 样式。"),
    "unicode.zero_width": ("发现零宽 Unicode 字符", "内容包含不可见零宽字符，可能用于隐藏标记或混淆文本。"),
    "unicode.bidi_control": ("发现方向控制 Unicode 字符", "内容包含 Bidi 方向控制字符，可能改变代码、URL 或命令的视觉顺序。"),
    "unicode.variation_selector": ("发现变体选择符", "内容包含 Unicode 变体选择符，可能用于隐写编码。"),
    "unicode.homograph": ("发现同形异义字符", "内容包含西里尔/希腊等同形字符，可能用于混淆或钓鱼。"),
    "network.ip_probe": ("检测到 IP 探测服务", "内容包含公网 IP 查询服务地址，可能用于泄露服务器 IP。"),
    "network.suspicious_domain": ("检测到可疑外部域名", "内容包含常用于数据接收的可疑域名（webhook/bin/ngrok/pastebin）。"),
    "network.external_url": ("检测到外部 URL", "内容包含外部 URL 链接。"),
    "network.tracking_pixel": ("检测到追踪像素", "内容包含 1x1 图片或 track/pixel/beacon 等追踪特征。"),
    "tool.shell.command": ("检测到命令行执行特征", "内容包含命令行执行特征（curl/wget/nc/bash -c 等），可能存在命令注入风险。"),
    "tool.shell.exfiltration": ("疑似敏感数据外传命令", "内容同时包含敏感文件/环境变量读取与外部网络传输特征，存在严重外泄风险。"),
    "file.sensitive_path": ("检测到敏感文件路径", "内容包含敏感系统文件路径（/etc/passwd, .ssh, .aws 等）。"),
    "tool.remote_script_exec": ("远程脚本执行", "内容包含 curl/wget 下载并通过管道交给 shell 执行的组合，存在远程代码执行风险。"),
    "tool.git_info": ("Git 信息泄露", "内容包含 git remote、gh auth token 等 Git 相关信息。"),
    "file.ssh_key": ("SSH 密钥文件", "内容包含 SSH 私钥文件名（id_rsa/id_ed25519/id_ecdsa）。"),
    "file.cloud_credentials": ("云凭证文件", "内容包含云凭证文件路径（.aws/credentials、.npmrc、.pypirc）。"),
    "infra.local_path": ("本地用户路径", "内容包含本地用户绝对路径（/Users/、C:\\Users\\、/home/）。"),
    "personal.email": ("邮箱地址", "内容包含邮箱格式的字符串。"),
    "personal.phone": ("手机号码", "内容包含中国大陆手机号格式。"),
}
#: Title and description of a custom rule's findings, and the summaries.
CUSTOM_SAID = ("自定义规则: {kind}", "匹配自定义blacklist规则: {pattern}")
NOTHING, SUMMARY, RESPONSE_PART = "未发现安全风险", "检测到 %d 条风险规则命中，涉及类别：%s（最高等级：%s）", " | 响应侧: "
PRIVATE_KEY_EVIDENCE, EVIDENCE_BYTES = "-----BEGIN PRIVATE KEY-----", 64


def lower_ascii(c: Column) -> Column:
    low = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(low)  # lower() of ASCII is much faster


def any_in(c: Column, patterns: list[str], bits: Column | None = None) -> Column:
    """Whether any pattern is contained; with the bits of WANTED, those of them are looked for only where they may be."""
    # what contains another pattern adds nothing
    each = [(F.contains(c, F.lit(p)), p.lower()) for p in patterns if not any(q != p and q in p for q in patterns)]
    return reduce(Column.__or__, [has if bits is None or p not in WANTED else is_set(bits, WANTED, p) & has for has, p in each])


def tokens(text: Column) -> Column:
    return F.split(text, "[" + DELIMITERS + "]")


def is_secret(t: Column) -> Column:
    known = reduce(Column.__or__, [t.startswith(p) & (F.octet_length(t) >= n) for p, n in SECRETS])
    return known | (t.startswith(WEB_TOKEN[0]) & (F.octet_length(t) >= WEB_TOKEN[1]) & F.contains(t, F.lit(".")))


def secret_token(text: Column, bits: Column | None = None) -> Column:
    """A token of a known form; texts without any such prefix are not split."""
    return any_in(text, [p for p, _ in SECRETS] + [WEB_TOKEN[0]], bits) & F.exists(tokens(text), is_secret)


def email(text: Column) -> Column:
    """A token with something before its first @ and a dotted domain of three bytes or more behind it."""
    domain = lambda t: F.substring(t, F.instr(t, "@") + 1, F.length(t))
    return F.contains(text, F.lit("@")) & F.exists(tokens(text), lambda t: (F.instr(t, "@") > 1) & F.contains(domain(t), F.lit(".")) & (F.octet_length(domain(t)) >= 3))


def snippet(text: Column) -> Column:
    """The text, or its longest beginning of whole characters within EVIDENCE_BYTES, and three dots."""
    start = F.left(text, F.lit(EVIDENCE_BYTES))
    fits = F.element_at(F.filter(F.sequence(F.lit(EVIDENCE_BYTES), F.lit(EVIDENCE_BYTES // 4), F.lit(-1)), lambda n: F.octet_length(F.left(text, n)) <= EVIDENCE_BYTES), 1)
    cut = F.when(F.octet_length(start) == EVIDENCE_BYTES, start).otherwise(F.left(text, fits))
    return F.when(F.octet_length(text) <= EVIDENCE_BYTES, text).otherwise(F.concat(cut, F.lit("...")))


#: What the built-in rules look for, in lower case and without the shortest.
WANTED = sorted({p.lower() for p in [*(p for *_, ps in RULES for p in ps), *(p for p, _ in SECRETS), *PRIVATE_KEYS, *SENSITIVE, *FETCH, *RUN, "curl", "wget"] if len(p) >= SIZE})


def unusual(text: Column) -> Column:
    """Whether a text holds a code point beyond Latin ones, as few do."""
    return (F.octet_length(text) > F.length(text)) & text.rlike(UNUSUAL)


def rules(text: Column, low: Column, bits: Column | None = None, odd: Column | None = None) -> list[tuple[str, str, str, Column]]:
    """(rule, category, severity, condition) of every built-in rule; faster with the text's bits of WANTED and whether it is unusual()."""
    has = lambda *ps: any_in(low, list(ps), bits)
    odd = unusual(text) if odd is None else odd
    return [
        ("credential.secret_token", "credential", "high", secret_token(text, bits)),
        ("credential.private_key", "credential", "critical", any_in(text, PRIVATE_KEYS, bits)),
        *[(r, c, s, has(*ps)) for r, c, s, ps in RULES],
        *[(r, "unicode", s, odd & text.rlike(x)) for r, s, x in UNICODE],
        ("tool.shell.exfiltration", "tool", "critical", has(*SENSITIVE) & has(*FETCH)),
        ("file.sensitive_path", "file", "high", has(*SENSITIVE)),
        ("tool.remote_script_exec", "tool", "critical", has("curl", "wget") & has("|") & has(*RUN)),
        ("personal.email", "personal", "low", email(text)),
        # the digit before it is looked for behind its first one, as few places have that
        ("personal.phone", "personal", "low", text.rlike(r"1(?<![0-9]1)[3-9][0-9]{9}(?![0-9])")),
    ]


def evidence(rule: str, text: Column, low: Column) -> Column:
    """What a rule's finding shows of the text: its first match, masked, a count, or the text's beginning."""
    if rule == "credential.secret_token":
        return mask_evidence(F.get(F.filter(tokens(text), is_secret), 0))
    if rule == "credential.private_key":
        return F.lit(PRIVATE_KEY_EVIDENCE)
    if rule == "credential.named_secret":
        return F.coalesce(*[F.when(F.contains(low, F.lit(p)), p) for p in RULES[0][3]])
    if pattern := {r: x for r, _, x in UNICODE}.get(rule):
        name = {"unicode.bidi_control": "bidi", "unicode.variation_selector": "variation"}.get(rule, rule.removeprefix("unicode."))
        return F.concat(F.lit(name + "_count="), F.regexp_count(text, F.lit(pattern)).cast("string"))
    return snippet(text)


FOUND = "rule_id", "category", "severity", "action", "evidence"


def built_in() -> list[tuple[str, str, str]]:
    """(rule, category, severity) of every built-in rule."""
    return [(r, category, severity) for r, category, severity, _ in rules(F.lit(""), F.lit(""))]


def with_findings(texts: DataFrame, *, disabled: tuple[str, ...] = (), whitelist: tuple[tuple[str, str], ...] = (), custom: tuple[tuple[str, ...], ...] = (), only: str | None = None, groups: tuple[str, ...] = ("unicode", "tool", "network"), proof: bool = True) -> DataFrame:
    """texts(id, text) with `found`, an array of (rule_id, category, severity, action, evidence).

    Built-in rules in `disabled` are left out, and of the categories that can be switched off
    those not in `groups`. A whitelist entry (kind, pattern) that the text contains exempts
    built-in findings of its kind's categories. Custom rules are (kind, pattern, severity,
    action); they are never exempt. `only` keeps the rules whose id is LIKE it. Null text has no
    findings. Text and lowered text are bound once, in the lambda, for all rules of a row; which
    patterns may be there is found in one pass over each text before.
    Without `proof` the evidence of built-in findings is null.
    """
    wanted = lambda r: only is None or like(r, only)

    def hits(text: Column, low: Column, odd: Column, bits: Column) -> Column:
        entry = lambda *v: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(c) for c, x in zip(FOUND, v, strict=True)])
        out = []
        for rule, category, severity, condition in rules(text, low, bits, odd):
            off = category in ("unicode", "network") and category not in groups or rule.split(".")[0] == "tool" and "tool" not in groups or rule == "file.sensitive_path" and "tool" not in groups
            if rule in disabled or off or not wanted(rule):
                continue
            exempt = [p.lower() for kind, p in whitelist if kind == "keyword" or category in EXEMPTS.get(kind, [])]
            out.append(F.when(condition & ~any_in(low, exempt) if exempt else condition, entry(rule, category, severity, "", evidence(rule, text, low) if proof else F.lit(None).cast("string"))))
        for kind, pattern, severity, action, *_ in custom:
            if wanted(f"custom.blacklist.{kind}"):
                out.append(F.when(F.contains(low, F.lit(pattern.lower())), entry(f"custom.blacklist.{kind}", "custom", severity, action, pattern)))
        empty = F.array().cast("array<struct<" + ",".join(f"{c}:string" for c in FOUND) + ">>")
        return F.array_compact(F.array(*out)) if out else empty

    once = F.struct(F.col("text").alias("t"), lower_ascii(F.col("text")).alias("l"), unusual(F.col("text")).alias("o"))
    return texts.withColumn("_may", may_contain(F.col("text"), WANTED)).withColumn("found", bound(once, lambda x: hits(x["t"], x["l"], x["o"], F.col("_may")))).drop("_may")


def like(value: str, pattern: str) -> bool:
    """SQL LIKE '%pattern%', ASCII case-insensitive."""
    parts = {"%": ".*", "_": "."}
    return re.search("".join(parts.get(c, re.escape(c)) for c in pattern), value, re.I | re.S | re.A) is not None


def findings(texts: DataFrame, **options) -> DataFrame:
    """(id, rule_id, category, severity): a row for each rule that fires on texts(id, text)."""
    return explode_findings(with_findings(texts, **options), "id").select("id", "rule_id", "category", "severity")


def explode_findings(found: DataFrame, *keys: str) -> DataFrame:
    """A row for each finding; an inner explode would evaluate all rules again in the filter it adds."""
    return found.select(*keys, F.explode_outer("found").alias("f")).select(*keys, "f.*").filter(F.col("rule_id").isNotNull())


def stored_findings(found: DataFrame, *keys: str, phase: str = "request", said: dict[str, str] | None = None) -> DataFrame:
    """Findings as a gateway stores them: phase, rule, severity, title, detail, location, evidence and their own action.

    `found` is with_findings() of texts with a location in `path`; `said` describes custom rules
    by pattern.
    """
    table = lambda k: F.create_map(*[F.lit(x) for r, v in SAID.items() for x in (r, v[k])])
    custom = F.col("category") == "custom"
    kind = F.element_at(F.split("rule_id", "[.]"), 3)
    own = F.create_map(*[F.lit(x) for kv in said.items() for x in kv])[F.col("evidence")] if said else F.lit(None).cast("string")
    detail = F.coalesce(own, F.concat(F.lit(CUSTOM_SAID[1].removesuffix("{pattern}")), "evidence"))
    rows = explode_findings(found, *keys, "path")
    return rows.select(
        *keys,
        F.lit(phase).alias("phase"),
        "rule_id",
        "category",
        "severity",
        F.when(custom, F.concat(F.lit(CUSTOM_SAID[0].removesuffix("{kind}")), kind)).otherwise(table(0)[F.col("rule_id")]).alias("title"),
        F.when(custom, detail).otherwise(table(1)[F.col("rule_id")]).alias("detail"),
        F.col("path").alias("location"),
        "evidence",
        F.when(F.col("action") == "", "warn").otherwise(F.col("action")).alias("action"),
    )


def base_of(severity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), severity)


def level_of(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 65, "high").when(score >= 35, "medium").when(score >= 15, "low").when(score >= 5, "info").otherwise("clean")


def total(base: Column, some) -> Column:
    """The worst severity's base plus bonuses for findings that make each other worse, 100 at most."""
    network, sensitive = some(lambda f: f["category"] == "network"), some(lambda f: f["rule_id"] == "file.sensitive_path")
    bonus = [
        (some(lambda f: f["category"] == "credential") & network, 25),
        (sensitive & network, 25),
        (some(lambda f: f["category"] == "unicode") & network, 15),
        (some(lambda f: f["rule_id"].startswith("tool.shell")) & sensitive, 20),
    ]
    return F.least(F.lit(100), reduce(Column.__add__, [F.when(c, n).otherwise(0) for c, n in bonus], F.coalesce(base, F.lit(0))))


def summary_of(count: Column, categories: Column, level: Column) -> Column:
    return F.when(count == 0, NOTHING).otherwise(F.format_string(SUMMARY, count, F.array_join(categories, ", "), level))


def scores(texts: DataFrame, *, summary: bool = False, **options) -> DataFrame:
    """scored() of texts(id, text) under options of with_findings()."""
    return scored(with_findings(texts, proof=False, **options), summary=summary)


#: A gateway's security settings before any is made.
DEFAULTS = {
    "enabled": "true",
    "mode": "audit",
    "scan_request": "true",
    "scan_response": "false",
    "scan_unicode": "false",
    "scan_tools": "true",
    "scan_network": "true",
    "redact_secrets": "true",
    "block_on_critical": "false",
    "max_scan_bytes": "65536",
}


def under_settings(found: DataFrame, *, phase: str = "request") -> DataFrame:
    """with_findings() of rows with a `setting` of DEFAULTS' names, less what it switches off.

    Nothing is found where scanning, or that of the phase, is off; the groups unicode, network and
    tools have a switch each. Texts are scanned whole, whatever max_scan_bytes says.
    """
    is_on = lambda name: F.col("setting")[name] == "true"
    tool = lambda f: f["rule_id"].startswith("tool.") | (f["rule_id"] == "file.sensitive_path")
    kept = F.filter("found", lambda f: ((f["category"] != "unicode") | is_on("scan_unicode")) & ((f["category"] != "network") | is_on("scan_network")) & (~tool(f) | is_on("scan_tools")))
    return found.withColumn("found", F.when(is_on("enabled") & is_on(f"scan_{phase}"), kept).otherwise(F.slice("found", 1, 0)))


def scored(found: DataFrame, *, summary: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, findings, level, blocked) for each text, and a summary; no finding is clean and 0.

    Columns to `keep` come last.

    `blocked` is whether a custom rule asks for a block.
    """
    some = lambda test: F.exists("found", test)
    score = total(F.array_max(F.transform("found", lambda f: base_of(f["severity"]))), some)
    categories = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["category"])))
    rows = found.select("id", score.alias("score"), F.size("found").cast("long").alias("findings"), some(lambda f: f["action"] == "block").alias("blocked"), *[categories.alias("categories")] * summary, *keep)
    said = [summary_of(F.col("findings"), F.col("categories"), level_of(F.col("score"))).alias("summary")] * summary
    return rows.select("id", "score", "findings", level_of(F.col("score")).alias("level"), "blocked", *said, *keep)


def body_scores(found: DataFrame) -> DataFrame:
    """(id, score, findings, level, blocked, summary) over all strings of each body.

    `found` is with_findings() of a body's strings; findings are counted and flags combined
    before the shuffle, so a body's findings are never gathered.
    """
    f = F.col("f")
    rows = found.select("id", F.explode_outer("found").alias("f"))
    some = lambda test: F.coalesce(F.bool_or(test(f)), F.lit(False))
    each = rows.groupBy("id").agg(
        total(F.max(base_of(f["severity"])), some).alias("score"),
        F.count("f").alias("findings"),
        some(lambda x: x["action"] == "block").alias("blocked"),
        F.array_sort(F.collect_set(f["category"])).alias("categories"),  # there are eight
    )
    level = level_of(F.col("score"))
    return each.select("id", "score", "findings", level.alias("level"), "blocked", summary_of(F.col("findings"), F.col("categories"), level).alias("summary"))


def mask(text: Column) -> Column:
    """First and last four characters; all of a value of eight or fewer."""
    return F.when(F.length(text) <= 8, "****").otherwise(F.concat(F.left(text, F.lit(4)), F.lit("****"), F.right(text, F.lit(4))))


def mask_evidence(text: Column) -> Column:
    """Line breaks as blanks; of more than 16 bytes the first eight and last four characters."""
    flat = F.translate(text, "\n", " ")
    return F.when(F.octet_length(flat) <= 16, flat).otherwise(F.concat(F.left(flat, F.lit(8)), F.lit("****"), F.right(flat, F.lit(4))))


#: A value that starts so (and has more than so many bytes) is masked whole.
MASKED = [("sk-", 12), ("sk-ant-", 0), ("sk-proj-", 0), ("AIza", 20), ("x-api-key:", 0), ("authorization: bearer", 0), ("ghp_", 0), ("gho_", 0), ("xoxb-", 0), ("AKIA", 0)]


#: The code points that are white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def is_whole_secret(text: Column) -> Column:
    """Whether a value as a whole is a secret, white space around it aside.

    Only its beginning is looked at, unless that is a secret's; the beginnings end without white space.
    """
    longer = lambda t, n: F.octet_length(F.rtrim(t, F.lit(WHITE_SPACE))) > n
    return bound(F.ltrim(text, F.lit(WHITE_SPACE)), lambda t: reduce(Column.__or__, [t.startswith(p) & longer(t, n) if n else t.startswith(p) for p, n in MASKED]))


def may_hold_secret(quoted: Column) -> Column:
    """Whether a compact JSON string may be a secret as a whole: it begins like one, or with an escape."""
    return bound(F.ltrim(quoted, F.lit('"' + WHITE_SPACE)), lambda t: reduce(Column.__or__, [t.startswith(p) for p, _ in MASKED], t.startswith("\\")))


def redact(values: DataFrame) -> DataFrame:
    """values(id, text) with secrets masked and whether that changed anything."""
    secret = F.coalesce(is_whole_secret(F.col("text")), F.lit(False))
    return values.select("id", F.when(secret, mask(F.col("text"))).otherwise(F.col("text")).alias("text"), secret.alias("changed"))


#: Keys whose values are masked, token prefixes with their least bytes, and key blocks.
SECRET_KEYS = ["api_key", "apikey", "secret", "secret_key", "access_key", "access_token", "auth_token", "token", "password", "passwd", "authorization", "cookie", "session", "sessionid", "private_key", "client_secret", "aws_secret_access_key", "secretkey"]
RICH_SECRETS = [("sk-", 24), ("sk-ant-", 30), ("ghp_", 20), ("AKIA", 16), ("AIza", 20)]
KEY_BLOCKS = ["OPENSSH PRIVATE KEY", "RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "DSA PRIVATE KEY", "CERTIFICATE", "ENCRYPTED PRIVATE KEY"]
BLOCK_MARK = "[REDACTED PRIVATE KEY BLOCK]"


def redact_inside(text: Column, key: Column | None = None) -> Column:
    """Text with the secrets inside it masked: known tokens, web tokens, bearer tokens, key blocks.

    Under a key that names a secret, a value of more than four bytes is masked first.
    """
    if key is not None:
        text = F.when(lower_ascii(key).isin(*SECRET_KEYS) & (F.octet_length(text) > 4), mask(text)).otherwise(text)
    word = r"[\p{IsAlphabetic}\p{N}_.:-]"
    known = lambda t: reduce(Column.__or__, [t.startswith(p) & (F.octet_length(t) >= n) for p, n in RICH_SECRETS]) | (t.startswith(WEB_TOKEN[0]) & (F.octet_length(t) >= WEB_TOKEN[1]) & F.contains(t, F.lit(".")))
    parts = F.regexp_extract_all(text, F.lit(f"{word}+|[^{word[1:]}+"), F.lit(0))
    text = F.array_join(F.transform(parts, lambda t: F.when(known(t), mask(t)).otherwise(t)), "")
    parts = F.regexp_extract_all(text, F.lit(r"(?is)bearer [^ \t\n\f\r]*|(?:(?!bearer ).)+"), F.lit(0))
    token = lambda t: F.substring(t, F.lit(8), F.length(t))
    short = lambda t: F.when(F.octet_length(t) > 6, F.concat(F.left(t, F.lit(2)), F.lit("****"), F.right(t, F.lit(2)))).otherwise("****")
    text = F.array_join(F.transform(parts, lambda t: F.when(lower_ascii(F.left(t, F.lit(7))) == "bearer ", F.concat(F.left(t, F.lit(7)), short(token(t)))).otherwise(t)), "")
    for kind in KEY_BLOCKS:
        text = F.regexp_replace(text, rf"(?is)(-----BEGIN {kind}-----).*-----END {kind}-----", "$1\n" + BLOCK_MARK + "\n")
    return text


def decide(scored: DataFrame, mode: str | Column, *, block_on_critical: bool | Column = False) -> DataFrame:
    """Adds the action of audit, warn, redact or block mode; blocks asked for by rules come last.

    Both settings may be columns, as they are under settings in force.

    A blocked row with a summary has it as its reason.
    """
    mode = F.lit(mode) if isinstance(mode, str) else mode
    strict = F.lit(block_on_critical) if isinstance(block_on_critical, bool) else block_on_critical
    bad = mode.isin("redact", "block") & F.col("level").isin("high", "critical") | (mode == "warn") & F.col("level").isin("medium", "high", "critical")
    action = F.when(strict & (F.col("level") == "critical"), "block").when(bad, mode).otherwise("allow")
    decided = scored.withColumn("action", F.when(F.col("blocked"), "block").otherwise(action))
    return decided.withColumn("blocked_reason", F.when(F.col("action") == "block", F.col("summary"))) if "summary" in scored.columns else decided


def merge_response(decided: DataFrame, responses: DataFrame, *, scan_response: bool = False) -> DataFrame:
    """Adds the findings of scored responses to decided requests of the same id.

    A request without findings has its response scanned only if `scan_response` is set. A worse
    level of the response takes over with the higher score; the action stays the request's.
    Where both have summaries, that of a worse response is added.
    """
    r = responses.select("id", F.col("score").alias("_score"), F.col("findings").alias("_found"), F.col("level").alias("_level"), *[F.col("summary").alias("_summary")] * ("summary" in responses.columns))
    rank = lambda c: F.array_position(F.array(*map(F.lit, BASE)), F.col(c))
    counts = (F.col("_found") > 0) & (F.lit(scan_response) | (F.col("findings") > 0))
    worse = counts & (rank("_level") > rank("level"))
    return decided.join(r, "id", "left").select(
        "id",
        F.when(worse, F.greatest("score", "_score")).otherwise(F.col("score")).alias("score"),
        (F.col("findings") + F.when(counts, F.col("_found")).otherwise(0)).alias("findings"),
        F.when(worse, F.col("_level")).otherwise(F.col("level")).alias("level"),
        "action",
        *[F.when(worse, F.concat("summary", F.lit(RESPONSE_PART), "_summary")).otherwise(F.col("summary")).alias("summary")] * ("summary" in decided.columns and "_summary" in r.columns),
    )
