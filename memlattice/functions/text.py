"""Tokenizers and other text expressions. Each returns a Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that prompts are searched without.
PROMPT_STOP_WORDS = ("a", "an", "and", "are", "as", "be", "for", "from", "in", "is", "it", "of", "on", "or", "should", "that", "the", "this", "to", "with")

# Plural endings, what stands for them, and how many letters must come before; the first that fits holds.
PLURALS = (("ies", "y", 2), ("sses", "ss", 1), ("ches", "ch", 1), ("shes", "sh", 1), ("xes", "x", 1), ("zes", "z", 1), ("ss", "ss", 1), ("us", "us", 1), ("is", "is", 1), ("s", "", 3))
#: A word in more than this share of all files is too common to name a concept alone.
COMMON_SHARE = 0.05

# What secrets look like, in the order in which they are masked.
SECRETS = {
    "header": r"(?i)\b(bearer|basic)[ \t]+[a-z0-9._~+/=-]{8,}",
    "assignment": r"""(?i)\b[a-z0-9_.-]*(api_?key|access_?key|passwd|password|secret|token)["']?[ \t]*[:=][ \t]*["']?[^\s"',;]+["']?""",
    "key": r"\b(sk|pk|rk)-[A-Za-z0-9_-]{16,}",
    "repository": r"\b(ghp|gho|ghs|ghu|ghr|glpat)[_-][A-Za-z0-9_]{20,}",
    "cloud": r"\b(AKIA|ASIA)[A-Z0-9]{16}\b",
}
MASK = "[hidden]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prompt_tokens(c: Column | str) -> Column:
    """Distinct lower-case words of two letters or more, in order, without stop words; camel case is split between a small and a large letter."""
    words = F.split(F.lower(F.regexp_replace(_col(c), "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*PROMPT_STOP_WORDS)))


def context_tokens(c: Column | str) -> Column:
    """Lower-case words of two letters or more with repeats and stop words; camel case is split after small letters and digits."""
    words = F.split(F.lower(F.regexp_replace(_col(c), "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.filter(words, lambda w: F.length(w) > 1)


def singular(w: Column) -> Column:
    """The word with its plural ending replaced as PLURALS has it."""
    out = w
    for ending, instead, least in reversed(PLURALS):
        out = F.when(w.rlike(f".{{{least}}}{ending}$"), F.regexp_replace(w, f"{ending}$", instead)).otherwise(out)
    return out


def concept_words(c: Column | str) -> Column:
    """Singular words of three letters or more that may take part in a concept."""
    words = F.split(F.lower(F.regexp_replace(_col(c), "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+")
    return F.filter(F.transform(words, singular), lambda w: F.length(w) >= 3)


def concept_terms(words: Column, common: list[str]) -> Column:
    """The distinct concepts of a row of words: words that are not ``common``, and compounds of two or three neighbours not all of which are."""
    is_common = lambda w: w.isin(*common) if common else F.lit(False)
    lone = F.filter(words, lambda w: ~is_common(w))

    def compounds(size: int) -> Column:
        grams = F.transform(words, lambda w, i: F.slice(words, i + 1, size))
        useful = F.filter(grams, lambda g: (F.size(g) == size) & F.exists(g, lambda w: ~is_common(w)))
        return F.transform(useful, lambda g: F.array_join(g, " "))

    return F.array_distinct(F.concat(lone, compounds(2), compounds(3)))


def slug(c: Column | str) -> Column:
    """Lower case, runs of anything but letters and digits as one dot, no dots at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "."), r"^\.+|\.+$", "")


def titled(c: Column | str) -> Column:
    """Words of an id, its separators as blanks, each with a capital."""
    return F.initcap(F.regexp_replace(_col(c), r"[-_.]+", " "))


def truncated(c: Column | str, width: int) -> Column:
    """The text, or its first characters and three dots if it is longer than ``width`` code points."""
    text = _col(c)
    return F.when(F.length(text) > width, F.concat(F.rtrim(F.substring(text, 1, width - 3)), F.lit("..."))).otherwise(text)


def within_bytes(c: Column | str, most: int, mark: str) -> Column:
    """The text, or what fits into ``most`` bytes of it and the mark; a character is never cut. UTF-8 bytes 80 to BF continue a character."""
    raw = F.encode(_col(c), "UTF-8")
    head = F.hex(F.substring(raw, 1, most))
    after = F.hex(F.substring(raw, most + 1, 1))
    cut = F.when(after.rlike("^[89AB]"), F.regexp_replace(head, "(?:[CDEF].)(?:[89AB].)*$", "")).otherwise(head)
    return F.when(F.octet_length(_col(c)) <= most, _col(c)).otherwise(F.concat(F.decode(F.unhex(cut), "UTF-8"), F.lit(mark)))


def redacted(c: Column | str) -> Column:
    """The text with everything that looks like a secret masked."""
    out = _col(c)
    for pattern in SECRETS.values():
        out = F.regexp_replace(out, pattern, MASK)
    return out


def secrets_found(c: Column | str) -> Column:
    """Struct of how many secrets each pattern masks, one after the other."""
    out, counts = _col(c), []
    for name, pattern in SECRETS.items():
        counts.append(F.coalesce(F.regexp_count(out, F.lit(pattern)), F.lit(0)).cast("bigint").alias(name))
        out = F.regexp_replace(out, pattern, MASK)
    return F.struct(*counts)


def numstat(line: Column | str) -> Column:
    """Struct added, deleted, path, binary of a line 'added TAB deleted TAB path'; a dash counts 0 lines of a binary file. Null for other lines."""
    parts = F.split(_col(line), "\t", 3)
    number = lambda i: F.when(F.get(parts, F.lit(i)) == "-", F.lit(0)).otherwise(F.get(parts, F.lit(i)).try_cast("bigint"))
    dash = (F.get(parts, F.lit(0)) == "-") | (F.get(parts, F.lit(1)) == "-")
    fits = _col(line).rlike(r"^(-|\d+)\t(-|\d+)\t[^\t]")
    return F.when(fits, F.struct(number(0).cast("bigint").alias("added"), number(1).cast("bigint").alias("deleted"), F.get(parts, F.lit(2)).alias("path"), dash.alias("binary")))


def fingerprint(c: Column | str) -> Column:
    """What stays of a note without its heading, fenced blocks, markup, case and spacing; equal for notes that say the same."""
    plain = F.regexp_replace(F.regexp_replace(_col(c), r"(?im)^#+\s*lesson\s*$", ""), r"(?s)```.*?```", " ")
    plain = F.lower(F.regexp_replace(plain, r"[`*_>#:\[\]()-]", " "))
    return F.btrim(F.regexp_replace(plain, r"\s+", " "))


def content_hash(c: Column | str) -> Column:
    """SHA-256 of the text with line ends as line feeds."""
    return F.sha2(F.regexp_replace(_col(c), "\r\n?", "\n").cast("binary"), 256)


def line_count(c: Column | str) -> Column:
    """Lines of the text; the empty text has one."""
    return F.size(F.split(_col(c), "\r?\n", -1)).cast("bigint")


def rounded(c: Column) -> Column:
    """To two decimals, halves up by the binary value."""
    return F.floor(c * 100 + 0.5) / 100
