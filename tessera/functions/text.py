"""Text columns: tokens, redaction, compression, documents' structure. All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a question: as keywords, and in ranking.
STOP_WORDS = (
    "what", "who", "where", "when", "how", "why", "which", "does", "do", "is", "are", "was", "were", "the", "a", "an", "in", "on", "at", "to", "for", "of",
    "with", "that", "this", "it", "its", "and", "or", "not", "can", "could", "would", "should", "all", "any", "there", "their", "they", "from", "about", "into",
    "through", "between", "being", "been",
)
RANKING_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "of", "and", "or", "how", "does", "what", "where", "which", "do", "connect", "connects",
    "use", "uses", "with",
)


def tokens(text: Column) -> Column:
    """Lower-case ASCII words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def keywords(text: Column) -> Column:
    """Words of a question that begin with a letter, have three letters or more and mean something; lower case, repeats included."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0)), lambda w: F.lower(w))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))


def ranking_terms(text: Column) -> Column:
    """Words for ranking: of two letters or more, without stop words."""
    return F.filter(tokens(text), lambda w: (F.length(w) > 1) & ~w.isin(*RANKING_STOP_WORDS))


def token_estimate(text: Column) -> Column:
    """Four characters make a token."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


# Redaction rules in order of application: name, pattern (Java), replacement.
RULES: tuple[tuple[str, str, str], ...] = (
    ("openai_key", r"\b(sk-(?:proj-)?[a-zA-Z0-9]{20,})\b", "[REDACTED:openai_key]"),
    ("anthropic_key", r"\b(sk-ant-[a-zA-Z0-9\-]{20,})\b", "[REDACTED:anthropic_key]"),
    ("github_pat", r"\b(gh[pousr]_[a-zA-Z0-9]{36,})\b", "[REDACTED:github_pat]"),
    ("stripe_key", r"\b(sk_(?:live|test)_[a-zA-Z0-9]{24,})\b", "[REDACTED:stripe_key]"),
    ("stripe_pub", r"\b(pk_(?:live|test)_[a-zA-Z0-9]{24,})\b", "[REDACTED:stripe_pubkey]"),
    ("aws_secret_key", r"(?i)(?:aws(?:_secret_access_key|_access_key_id|_session_token)?)[=\s:]+['\"]?((?:AKIA|AGPA|AIDA|AROA|ASCA)[A-Z0-9]{16}|(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])|aws_sec_[a-zA-Z0-9]+)['\"]?", "[REDACTED:aws_key]"),
    ("google_api_key", r"\b(AIza[0-9A-Za-z\-_]{35,})\b", "[REDACTED:google_api_key]"),
    ("sendgrid_key", r"\b(SG\.[a-zA-Z0-9\-_]{22}\.[a-zA-Z0-9\-_]{43})\b", "[REDACTED:sendgrid_key]"),
    ("slack_token", r"\b(xoxb-[A-Za-z0-9\-]{10,})\b", "[REDACTED:slack_token]"),
    ("twilio_token", r"\b(SK[a-f0-9]{32})\b", "[REDACTED:twilio_key]"),
    ("pem_private_key", r"(?s)(-----BEGIN (?:RSA |EC |DSA |OPENSSH |PRIVATE |CERTIFICATE )?(?:PRIVATE )?KEY-----[\s\S]*?-----END [^-]+-----)", "[REDACTED:private_key_block]"),
    ("password_assignment", r"(?i)((?:password|passwd|secret|api[_\-]?key|auth[_\-]?token|access[_\-]?token|secret[_\-]?key)\s*(?:=|:)\s*)([\"']?)([^\"'\s\n]{8,})\2", "$1$2[REDACTED:secret_value]$2"),
    ("env_secret", r"(?i)(^|\n)((?:API[_\-]?KEY|SECRET|PASSWORD|AUTH[_\-]?TOKEN|ACCESS[_\-]?TOKEN|PRIVATE[_\-]?KEY|SIGNING[_\-]?KEY|JWT[_\-]?SECRET)\s*=\s*[\"']?)([^\n\"'\s]{8,})([\"']?)", "$1$2[REDACTED:env_secret]$4"),
    ("db_connection_string", r"(?i)((?:postgres|postgresql|mysql|mongodb|redis|mssql|sqlite|amqp|redis)(?:\+\w+)?://)([^:]+):([^@]+)@", "$1[REDACTED:db_user]:[REDACTED:db_pass]@"),
    ("jwt_token", r"\b(eyJ[a-zA-Z0-9\-_]{20,}\.[a-zA-Z0-9\-_]{20,}\.[a-zA-Z0-9\-_]{20,})\b", "[REDACTED:jwt_token]"),
    ("high_entropy_hex", r"(?i)(?:token|secret|key|hash|credential)\s*[=:]\s*[\"']?([0-9a-f]{32,64})[\"']?", "[KEY]=[REDACTED:hex_secret]"),
    ("high_entropy_base64", r"(?i)(?:token|secret|key|hash|credential|cert|certificate|apikey|api_key|auth)\s*[=:]\s*[\"']?((?:[A-Za-z0-9+/]{4}){6,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{4})?)[\"']?", "[KEY]=[REDACTED:base64_secret]"),
)
OPTIONAL_RULES: tuple[tuple[str, str, str], ...] = (
    ("email", r"\b([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})\b", "[REDACTED:email]"),
    ("ipv4", r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b", "[REDACTED:ip]"),
)


#: A piece of text without which a rule can't match: looking for it is far cheaper than the pattern.
NEEDS = {
    "openai_key": "sk-", "anthropic_key": "sk-ant-", "github_pat": "_", "stripe_key": "sk_", "stripe_pub": "pk_", "google_api_key": "AIza", "sendgrid_key": "SG.",
    "slack_token": "xoxb-", "twilio_token": "SK", "pem_private_key": "-----BEGIN", "env_secret": "=", "db_connection_string": "://", "jwt_token": "eyJ", "email": "@", "ipv4": ".",
}


def _may(text: Column, rule: str) -> Column:
    return F.contains(text, F.lit(NEEDS[rule])) if rule in NEEDS else F.lit(True)


def scrub(text: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The text after all rules, each applied to what the one before left."""
    state = F.array(text)
    for name, pattern, replacement in rules:
        state = F.transform(state, lambda t: F.when(_may(t, name), F.regexp_replace(t, pattern, replacement)).otherwise(t))  # noqa: B023
    return state[0]


def rule_counts(text: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """array<struct<rule, n>>: matches of each rule in the text as it stands at that rule; each stage of the text is worked out once."""
    state = F.array(F.struct(text.alias("now"), F.array().cast("array<struct<rule:string,n:bigint>>").alias("out")))

    for name, pattern, replacement in rules:

        def counted(s: Column) -> Column:
            n = F.when(_may(s["now"], name), F.regexp_count(s["now"], F.lit(pattern)).cast("long")).otherwise(0)  # noqa: B023
            return F.struct(s["now"].alias("now"), s["out"].alias("out"), n.alias("n"))

        def replaced(s: Column) -> Column:
            now = F.when(s["n"] > 0, F.regexp_replace(s["now"], pattern, replacement)).otherwise(s["now"])  # noqa: B023
            return F.struct(now.alias("now"), F.concat(s["out"], F.array(F.struct(F.lit(name).alias("rule"), s["n"].alias("n")))).alias("out"))  # noqa: B023

        state = F.transform(F.transform(state, counted), replaced)
    return state[0]["out"]


def has_secrets(text: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    return reduce(lambda a, b: a | b, [_may(text, n) & text.rlike(p) for n, p, _ in rules])


def strip_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)[ \t]+$", "")


def collapse_blank(text: Column) -> Column:
    """Three newlines or more become two."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def strip_badges(text: Column) -> Column:
    """Without lines that are a badge image."""
    kinds = "Build|CI|Tests?|Coverage|Version|License|NPM|PyPI|Downloads?|Stars?|Issues?|PRs?|codecov|GitHub"
    return F.regexp_replace(text, rf"(?im)^\[?!\[(?:{kinds})[^\]]*\]\([^)]+\)\]?(?:\([^)]+\))?\s*\n", "")


def strip_install(text: Column) -> Column:
    """Without sections on installing and starting, each up to the next heading."""
    return F.regexp_replace(text, r"(?im)^#{1,3}\s*(?:Installation|Install|Getting Started|Quick Start)\b[^\n]*\n(?:(?!^#)[^\n]*\n)*", "")


# What a licence header looks like: comment blocks, docstrings, comment lines.
LICENSES = (
    r"(?im)^/\*[\s\S]*?(?:MIT License|Apache License|GNU General|SPDX)[\s\S]*?\*/\s*",
    r'(?im)^"""[\s\S]*?(?:MIT License|Apache License|GNU General|Copyright)[\s\S]*?"""\s*',
    r"(?im)^\'\'\'[\s\S]*?(?:MIT License|Apache License|GNU General|Copyright)[\s\S]*?\'\'\'\s*",
    r"(?im)^(?:#|//|<!--).*?(?:Copyright|License|SPDX).*\n(?:(?:#|//|<!--).*\n)*",
)


def strip_license(text: Column) -> Column:
    return F.regexp_replace(reduce(lambda t, p: F.regexp_replace(t, p, ""), LICENSES, text), r"\A\n+", "")


def _rewritten(text: Column, block: str, one) -> Column:
    """The text with each match of `block` put through `one`: gaps and matches are zipped together again."""
    both = F.struct(F.split(text, block, -1).alias("g"), F.regexp_extract_all(text, F.lit(block), F.lit(0)).alias("m"))
    joined = lambda x: F.array_join(F.transform(x["g"], lambda g, i: F.concat(g, F.when(i < F.size(x["m"]), one(F.get(x["m"], i))).otherwise(""))), "")
    return F.transform(F.array(both), joined)[0]


def compress_imports(text: Column) -> Column:
    """Each block of import lines (Python, then JavaScript) as one comment with the first eight distinct names."""

    def line(mark: str, name: str):
        def one(block: Column) -> Column:
            names = F.regexp_extract_all(block, F.lit(name), F.lit(1))
            more = F.when(F.size(names) > 8, ", ...").otherwise("")
            return F.concat(F.lit(f"{mark} imports: "), F.array_join(F.slice(F.array_distinct(names), 1, 8), ", "), more, F.lit("\n"))

        return one

    python = _rewritten(text, r"(?m)(?:^(?:import|from)\s+\S+[^\n]*\n)+", line("#", r"(?:import|from)\s+(\w+)"))
    return _rewritten(python, r"""(?m)(?:^import\s+.*?from\s+['"][^'"]+['"]\s*;?\s*\n)+""", line("//", r"""from\s+['"]([^'"]+)['"]"""))


def strip_redundant_comments(text: Column) -> Column:
    """Without comment lines that begin with a plain verb and stand over a line, as deep, that does just that."""
    verbs = "increment|decrement|return|set|get|call|check|add|remove|create|delete|update|loop|iterate|print|log"
    return F.regexp_replace(text, rf"(?im)^([ \t]*)#\s*(?:{verbs})\b[^\n]*\n(?=\1(?:return|counter|result|self\.|[a-z_]+\s*[+\-*]=|print|log)\b)", "")


_DEFINITION = r"(?:def|class)\s+\w+[^\n]*:\n(?:[ \t]+(?!def |class )[^\n]*\n)*"
_BODY = r"((?:export\s+)?(?:async\s+)?(?:function|class|const\s+\w+\s*=\s*(?:async\s+)?(?:function|\())[^\n]*)\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)?\}"


def signatures_only(text: Column) -> Column:
    """Definitions without their bodies: Python keeps the head and at most 200 characters of a docstring, JavaScript the head."""

    def head(block: Column) -> Column:
        first = F.concat(F.substring_index(block, "\n", 1), F.lit("\n"))
        doc = F.regexp_extract(block, r'(?s)\A[^\n]*\n[ \t]+"""(.*?)"""', 1)
        has = block.rlike(r'(?s)\A[^\n]*\n[ \t]+""".*?"""')
        return F.concat(first, F.when(has, F.concat(F.lit('    """'), F.substring(doc, 1, 200), F.lit('"""\n'))).otherwise("    ...\n"))

    script = F.when(text.rlike(r"\bfunction\b|\bclass\b"), F.regexp_replace(text, _BODY, r"$1 { ... }")).otherwise(text)
    return F.when(text.rlike(r"(?m)^(?:def |class )"), _rewritten(text, _DEFINITION, head)).otherwise(script)


def repeated_lines_removed(text: Column, times: int = 3, longest: int = 80) -> Column:
    """Without short, non-blank lines that occur `times` times or more. Sorted, a line's repeats are neighbours, so the cost is that of
    a sort, not of all pairs."""

    def rare(lines: Column) -> Column:
        short = F.array_sort(F.filter(lines, lambda x: (F.length(F.trim(x)) < longest) & (F.trim(x) != "")))

        def often(s: Column) -> Column:
            return F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i + times - 1)))

        return F.transform(F.array(F.transform(F.array(short), often)[0]), lambda noise: F.array_join(F.filter(lines, lambda x: ~F.array_contains(noise, x)), "\n"))[0]

    return F.transform(F.array(F.split(text, "\n")), rare)[0]


# Suffixes whose texts are compressed as code and as documents; above so many characters code keeps signatures only.
CODE_SUFFIXES = ("py", "ts", "tsx", "js", "jsx", "go", "rs", "java", "kt", "swift", "dart", "vue", "rb", "php", "cs", "cpp", "c", "h")
DOCUMENT_SUFFIXES = ("md", "rst", "txt", "mdx")
LONG_CODE = 20_000


def compressed(text: Column, path: Column | None = None, aggressive: bool = False) -> Column:
    """A text without what a model needn't read, by the file's suffix: licence header and line ends for all; import blocks and redundant
    comments (and bodies of long files) for code; badges, install sections and blank lines for documents; repeated lines for pdf."""
    base = strip_line_ends(strip_license(text))
    if path is None:
        return collapse_blank(strip_install(strip_badges(base)))
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    bound = lambda t, f: F.transform(F.array(t), f)[0]  # noqa: E731  (works t out once)
    short = F.lit(False) if aggressive else F.length(text) <= LONG_CODE
    return bound(base, lambda b: F.when(suffix.isin(*CODE_SUFFIXES), bound(strip_redundant_comments(compress_imports(b)), lambda x: F.when(short, x).otherwise(signatures_only(x))))
        .when(suffix.isin(*DOCUMENT_SUFFIXES), collapse_blank(strip_install(strip_badges(b))))
        .when(suffix == "pdf", collapse_blank(repeated_lines_removed(b)))
        .otherwise(collapse_blank(b)))


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.trim(text), r"\s+", " "), r"^([^.!?]{5,150}[.!?])", 1)


def first_paragraph(text: Column, enough: int = 150, most: int = 200) -> Column:
    """The first lines that are no headings, joined, up to a blank line or `enough` characters; at most `most` characters."""
    zero = F.struct(F.lit("").alias("t"), F.lit(False).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        joined = F.when(acc["t"] == "", line).otherwise(F.concat(acc["t"], F.lit(" "), line))
        blank, skip = line == "", line.rlike("^[#=]")
        t = F.when(acc["done"] | blank | skip, acc["t"]).otherwise(joined)
        return F.struct(t.alias("t"), (acc["done"] | (blank & (acc["t"] != "")) | (F.length(t) > enough)).alias("done"))

    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.substring(F.aggregate(lines, zero, step)["t"], 1, most)


def headings(text: Column) -> Column:
    """array<struct<level, title>> of markdown headings, levels 1 to 4."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^#{1,4}[ \t]+[^\n]+$"), F.lit(0))
    return F.transform(found, lambda h: F.struct(F.length(F.regexp_extract(h, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(h, "^#+[ \t]+", "")).alias("title")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))
