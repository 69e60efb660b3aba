"""Class labels: the canonical label of a free-text class name, by keywords in a fixed order, with evidence texts as a second source."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# fixed values: keywords and the label that the first of them found stands for; the order matters
LABELS: list[tuple[tuple[str, ...], str]] = [
    (("nosql", "no sql", "no-sql"), "CWE-943 Improper Neutralization of Special Elements in Data Query Logic"),
    (("sql", "sql注入"), "CWE-89 SQL Injection"),
    (("command injection", "命令注入", "cmdi"), "CWE-78 Command Injection"),
    (("code injection", "代码注入", "codei"), "CWE-94 Code Injection"),
    (("expression language injection", "expression injection", "expression language", "spel", "ognl", "表达式注入"), "CWE-917 Improper Neutralization of Special Elements in Data Query Logic"),
    (("insecure deserialization", "反序列化", "deserial", "pickle"), "CWE-502 Deserialization of Untrusted Data"),
    (("cross-site request forgery", "csrf", "跨站请求伪造"), "CWE-352 Cross-Site Request Forgery"),
    (("cross-site", "cross site", "xss", "跨站"), "CWE-79 Cross-Site Scripting"),
    (("path traversal", "directory traversal", "路径穿越", "path_traversal"), "CWE-22 Path Traversal"),
    (("server-side template injection", "模板注入", "ssti"), "CWE-1336 Improper Neutralization of Special Elements Used in a Template Engine"),
    (("log injection", "日志注入", "logi"), "CWE-117 Improper Output Neutralization for Logs"),
    (("ldap injection", "ldap注入", "ldap filter", "ldap"), "CWE-90 Improper Neutralization of Special Elements used in an LDAP Statement"),
    (("secret keyword", "hardcoded password", "hard-coded password", "hardcoded api key", "hard-coded api key", "硬编码密码", "硬编码密钥"), "CWE-798 Use of Hard-Coded Credentials"),
    (("ssrf", "server-side request forgery", "服务端请求伪造"), "CWE-918 Server-Side Request Forgery (SSRF)"),
    (("xxe", "xml external entity", "xml 实体注入", "xml external entity reference"), "CWE-611 Improper Restriction of XML External Entity Reference"),
    (("xpath injection", "xpath注入"), "CWE-643 Improper Neutralization of Special Elements in XPath Expression"),
    (("no-secure", "cookie without 'secure'"), "CWE-614 Sensitive Cookie in HTTPS Session Without 'Secure' Attribute"),
    (("insecure cookie", "no-httponly", "cookie without 'httponly'"), "CWE-1004 Sensitive Cookie Without 'HttpOnly' Flag"),
    (("mass assignment", "批量赋值"), "CWE-915 Improperly Controlled Modification of Dynamically-Determined Object Attributes"),
    (("type juggling", "type confusion", "松散比较", "magic hash", "类型混淆"), "CWE-843 Access of Resource Using Incompatible Type ('Type Confusion')"),
    (("unrestricted file upload", "unrestricted upload", "任意文件上传"), "CWE-434 Unrestricted Upload of File with Dangerous Type"),
    (("redos", "regular expression denial", "灾难性回溯", "catastrophic backtracking"), "CWE-1333 Improper Neutralization of Special Elements Used in a Regular Expression"),
    (("weak password", "password policy", "口令策略", "弱口令"), "CWE-521 Weak Password Requirements"),
    (("cleartext storage", "明文存储"), "CWE-312 Cleartext Storage of Sensitive Information"),
    (("information exposure through error", "error message disclosure"), "CWE-209 Information Exposure Through Error Message"),
    (("cryptographic signature", "signature verification"), "CWE-347 Improper Verification of Cryptographic Signature"),
    (("session fixation", "会话固定"), "CWE-384 Session Fixation"),
    (("hardcoded credential", "hard-coded credential", "hardcoded secret", "hard-coded secret", "hardcoded token", "hard-coded token", "硬编码凭据", "硬编码凭证"), "CWE-798 Use of Hard-Coded Credentials"),
    (("jwt", "json web token"), "CWE-347 Improper Verification of Cryptographic Signature"),
    (("open redirect", "开放重定向", "url 重定向"), "CWE-601 Open Redirect"),
    (("prototype pollution", "原型污染", "原型链污染"), "CWE-1321 Improperly Controlled Modification of Object Prototype Attributes ('Prototype Pollution')"),
    (("weak cryptography", "weak crypto", "weak hash", "weak cipher", "弱加密", "弱哈希", "弱密码学"), "CWE-327 Use of a Broken or Risky Cryptographic Algorithm"),
    (("weak random", "insecure random", "弱随机", "可预测随机数"), "CWE-338 Use of Cryptographically Weak Pseudo-Random Number Generator (PRNG)"),
    (("hardcoded iv", "hard-coded iv", "hardcoded initialization vector", "硬编码初始向量"), "CWE-329 Generation of Predictable IV with CBC Mode"),
    (("integer overflow", "整数溢出"), "CWE-190 Integer Overflow or Wraparound"),
    (("timing attack", "timing side channel", "时序攻击", "时序侧信道"), "CWE-208 Observable Timing Discrepancy"),
]
# fixed values: keywords that count as whole words only
WHOLE_WORDS = ["cmdi", "codei", "logi", "ldap"]
# fixed values: evidence that outweighs a class number in the field itself
STRONG_EVIDENCE = [(("prototype pollution", "原型污染", "原型链污染", "__proto__"), "CWE-1321 Improperly Controlled Modification of Object Prototype Attributes ('Prototype Pollution')")]
# fixed values: the direct parent of a class
PARENT = {"CWE-917": "CWE-94", "CWE-1336": "CWE-94", "CWE-80": "CWE-79", "CWE-95": "CWE-94"}


def _first(text: Column, table) -> Column:
    """The label of the first row of the table with a keyword in the text; null without one."""

    def found(low: Column) -> Column:
        hits = [F.when(F.greatest(*[low.rlike(rf"(?U)\b{k}\b") if k in WHOLE_WORDS else F.contains(low, F.lit(k)) for k in keys], F.lit(False)), F.lit(label)) for keys, label in table]
        return F.coalesce(*hits, F.lit(None).cast("string"))

    # bound as a variable, the text is lower-cased once and not for every keyword
    return F.get(F.transform(F.array(F.lower(text)), found), F.lit(0))


def class_label(raw) -> Column:
    """The canonical label of a class name; other names as they are, trimmed; 'none' for null, empty or none."""
    t = F.trim(F.coalesce(col(raw), F.lit("")))
    return F.when((t == "") | (F.lower(t) == "none"), F.lit("none")).otherwise(F.coalesce(_first(t, LABELS), t))


def class_with_evidence(raw, evidence) -> Column:
    """The field's label by its own keywords, then its own number (unless the evidence is strong), then by keywords of the evidence."""
    t = F.trim(F.coalesce(col(raw), F.lit("")))
    why = F.coalesce(col(evidence), F.lit(""))
    named = (t != "") & (F.lower(t) != "none")
    own = F.coalesce(_first(t, LABELS), F.when(t.rlike("(?i)CWE[- ]?[0-9]+"), F.coalesce(_first(why, STRONG_EVIDENCE), t)))
    return F.coalesce(F.when(named, own), _first(why, LABELS), _first(why, STRONG_EVIDENCE), class_label(raw))


def _number(c: Column) -> Column:
    n = F.regexp_extract(F.coalesce(c, F.lit("")), "CWE[- ]?([0-9]+)", 1)
    return F.when(n != "", F.concat(F.lit("CWE-"), n))


def same_family(reported, expected) -> Column:
    """Whether two labels have one number, or one is an ancestor of the other; false where a number is missing."""
    a, b = _number(col(reported)), _number(col(expected))
    up = F.create_map(*[F.lit(x) for k, v in PARENT.items() for x in (k, v)])

    def above(x: Column, y: Column) -> Column:
        steps, at = F.lit(False), x
        for _ in range(len(PARENT)):
            at = up[at]
            steps = steps | F.coalesce(at == y, F.lit(False))
        return steps

    return F.coalesce((a == b) | above(a, b) | above(b, a), F.lit(False))
