"""Text functions: tokenisers, redaction, scans, validators, ids and normalisation, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: One CJK character, or a run of word characters.
WORD_OR_CJK = r"[\x{4e00}-\x{9fff}]|[A-Za-z0-9_]+"
#: The characters that count as space, and what ends a line.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = "\r\n|[\n\v\f\r\x1c\x1d\x1e\x85\u2028\u2029]"
#: SPACES but for the plain one, as a class that settles ASCII first.
_ODD_SPACE = r"[\t-\r\x1c-\x1f[\x80-\x{ffff}&&[\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
#: A token of chunk_tokens in a text of plain spaces: a CJK character is a symbol like others here.
_TOKEN = r"(?:\w+|[^ ])"
#: Patterns replaced in this order; each works on what the ones before have left.
PII = (
    r"1[3-9]\d{9}",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"\b\d{15}(\d{2}[0-9Xx])?\b",
    r"\b(?:\d[ -]?){13,19}\b",
    r"(?i)(api[_-]?key|token|cookie)\s*[:=]\s*[A-Za-z0-9._-]+",
    r"(?i)bearer\s+[A-Za-z0-9._=-]{16,}",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
)
#: Any match blocks a text.
INJECTION = (
    r"(?i)ignore previous instructions",
    r"(?i)ignore (all )?(system|developer|safety) instructions",
    r"(?i)system prompt",
    r"(?i)tool call",
    r"(?i)disable safety",
    r"(?i)reveal (the )?(system|developer) prompt",
    r"(?i)delete (all )?(negative )?reviews?",
    r"(?i)bypass (approval|human review|guardrail)",
    r"忽略.{0,8}(系统|安全|开发者|指令)",
    r"(泄露|输出|打印).{0,8}(系统提示|system prompt|开发者提示)",
    r"(删除|清空|篡改).{0,8}(差评|评论|数据库|记录)",
)
#: Codes of a content scan and the words that give them.
SCAN = {
    "PROMPT_INJECTION_DETECTED": ("ignore previous instructions", "system prompt"),
    "SECRET_LIKE_CONTENT_DETECTED": ("api_key=", "bearer "),
}
#: Events of the input check, their action and the words that give them.
GUARDRAIL = {
    "prompt_injection_like": ("block", ("ignore", "忽略", "password", "数据库密码")),
    "secret_exposure_request": ("block", ("api key", "密钥")),
}
#: Validators by name; the whole text must match.
VALID = {
    "mobile_simple": r"[1]\d{10}",
    "mobile_exact": r"((13[0-9])|(14[5,7])|(15[0-3,5-9])|(16[6])|(17[0,1,3,5-8])|(18[0-9])|(19[8,9]))\d{8}",
    "tel": r"0\d{2,3}[- ]?\d{7,8}",
    "id_card15": r"[1-9]\d{7}((0\d)|(1[0-2]))(([0|1|2]\d)|3[0-1])\d{3}",
    "id_card18": r"[1-9]\d{5}[1-9]\d{3}((0\d)|(1[0-2]))(([0|1|2]\d)|3[0-1])\d{3}([0-9Xx])",
    "email": r"\w+([-+.]\w+)*@\w+([-.]\w+)*\.\w+([-.]\w+)*",
    "url": r"[a-zA-z]+://[^\s]*",
    "zh": r"[\x{4e00}-\x{9fa5}]+",
    "username": r"[\w\x{4e00}-\x{9fa5}]{6,20}(?<!_)",
    "date": r"(?:(?!0000)[0-9]{4}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)|(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00)-02-29)",
    "ip": r"((2[0-4]\d|25[0-5]|[01]?\d\d?)\.){3}(2[0-4]\d|25[0-5]|[01]?\d\d?)",
    "double_byte": r"[^\x00-\xff]",
    "blank_line": r"\n\s*\r",
    "qq": r"[1-9][0-9]{4,}",
    "postal_code": r"[1-9]\d{5}(?!\d)",
    "positive_integer": r"[1-9]\d*",
    "negative_integer": r"-[1-9]\d*",
    "integer": r"-?[1-9]\d*",
    "not_negative_integer": r"[1-9]\d*|0",
    "not_positive_integer": r"-[1-9]\d*|0",
    "positive_float": r"[1-9]\d*\.\d*|0\.\d*[1-9]\d*",
    "negative_float": r"-[1-9]\d*\.\d*|-0\.\d*[1-9]\d*",
}


def tokens(text: Column) -> Column:
    """Lower-cased words and single CJK characters, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_OR_CJK), F.lit(0))


def chunk_tokens(text: Column) -> Column:
    """Tokens with every other symbol that isn't a space as one of its own; case is kept."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{WORD_OR_CJK}|[^{SPACES}]"), F.lit(0))


def plain_spaces(text: Column) -> Column:
    """The text with every character of SPACES made a plain space; a pattern looks for what is rarer than line ends."""
    return _once(F.replace(text, F.lit("\n"), F.lit(" ")), lambda t: F.when(t.rlike(_ODD_SPACE), F.regexp_replace(t, _ODD_SPACE, " ")).otherwise(t))


def _run(n: int) -> str:
    """Pattern of up to n tokens with what is between them. It starts with a token, so spaces are passed once."""
    return _TOKEN if n == 1 else f"{_TOKEN}(?: *{_TOKEN}){{0,{n - 1}}}+"


def token_windows(text: Column, size: int, step: int) -> Column:
    """The windows of size tokens that start at every step-th token of a text of plain spaces, as they stand in it; one empty
    window of a text without tokens. One match takes a whole window, so single tokens are never made."""
    window = _run(step) if size == step else f"(?=({_run(size)})){_run(step)}"
    return F.regexp_extract_all(text, F.lit(rf"{window}|\A *+\z"), F.lit(0 if size == step else 1))


def token_count(text: Column, part: int = 13) -> Column:
    """Number of tokens of a text of plain spaces, of which only the last few are made."""
    return _once(token_windows(text, part, part), lambda w: (F.size(w) - 1) * part + F.size(chunk_tokens(F.element_at(w, -1))))


def char_grams(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Character n-grams of the lower-cased text with runs of two or more spaces made one space."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s{2,}", " ")
    chars = F.array_remove(F.split(t, ""), "")
    longer = lambda grams, n: F.zip_with(grams, F.slice(chars, n, F.greatest(F.size(chars), F.lit(1))), lambda a, c: F.concat(a, c))  # noqa: E731  null past the end
    each = [chars]
    for n in range(2, max(sizes) + 1):
        each.append(longer(each[-1], n))
    return F.filter(F.flatten(F.array(*(each[n - 1] for n in sizes))), lambda g: g.isNotNull())


def redact(text: Column, marker: str = "[REDACTED]") -> Column:
    """The text without personal data."""
    for pattern in PII:
        text = F.regexp_replace(text, pattern, marker)
    return text


def redactions(text: Column, clean: Column, marker: str = "[REDACTED]") -> Column:
    """How many places were replaced: no pattern can match or make a marker, so those that are new count."""
    times = lambda t: (F.length(t) - F.length(F.replace(t, F.lit(marker), F.lit("")))) / len(marker)
    return (times(clean) - times(text)).cast("int")


def injections(text: Column) -> Column:
    """Numbers of the injection patterns that match."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(i)) for i, p in enumerate(INJECTION))))


def _once(value: Column, used: Callable[[Column], Column]) -> Column:
    """used(value), where value is worked out once a row however often used names it, also in a filter that is pushed down."""
    return F.get(F.transform(F.array(value), used), F.lit(0))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def scan(text: Column, words: dict[str, tuple[str, ...]] = SCAN) -> Column:
    """Codes whose words occur in the lower-cased text, in the order given."""
    return _once(F.lower(text), lambda low: F.array_compact(F.array(*(F.when(_holds(low, listed), F.lit(code)) for code, listed in words.items()))))


def guardrail(text: Column) -> tuple[Column, Column]:
    """Events of the input check in order, and whether the text is allowed: only blocking events forbid it, a text of
    fewer than three characters only warns. A null text is empty."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    short = F.length(F.regexp_replace(t, r"^[\x00-\x20]+|[\x00-\x20]+$", "")) < 3
    hits = {name: _holds(low, words) for name, (_, words) in GUARDRAIL.items()}
    events = F.array_compact(F.array(F.when(short, F.lit("too_short_input")), *(F.when(hit, F.lit(name)) for name, hit in hits.items())))
    blocked = F.lit(False)
    for name, (action, _) in GUARDRAIL.items():
        if action == "block":
            blocked = blocked | hits[name]
    return F.when(F.size(events) == 0, F.array(F.lit("review_content_allowed"))).otherwise(events), ~blocked


def is_valid(kind: str, text: Column) -> Column:
    """Whether the whole text matches; an empty or null text is never valid."""
    return F.coalesce((text != "") & text.rlike(rf"\A(?:{VALID[kind]})\z"), F.lit(False))


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def trimmed_to(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def snippet(evidence: Column, text: Column, n: int = 120) -> Column:
    """The first n characters of the evidence, or of the text where that is blank."""
    return F.substring(F.when(blank(evidence), F.coalesce(text, F.lit(""))).otherwise(evidence), 1, n)


def scrub(text: Column, n: int = 240) -> Column:
    """An error message fit to show: local paths and keys hidden, cut, '-' when blank."""
    t = F.regexp_replace(text, r"[A-Za-z]:\\[^\s]+", "[local-path]")
    t = F.regexp_replace(t, r"(?i)api[_-]?key\s*[:=]\s*\S+", "api_key=[hidden]")
    return F.when(blank(t), F.lit("-")).otherwise(F.substring(t, 1, n))


def normal_lines(text: Column) -> Column:
    """Line ends as \\n, no spaces at line ends, trimmed."""
    has = lambda t, *parts: reduce(or_, (t.contains(x) for x in parts))
    ends = lambda t: F.when(has(t, "\r"), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t)
    full = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?m)[ \t]+$", ""), r"^\s+|\s+$", "")
    # The patterns are slow on long texts and rarely find anything but at the ends; they decide where $ is more than \n.
    trim = lambda t: F.when(has(t, " \n", "\t\n", "\x85", "\u2028", "\u2029"), full(t)).otherwise(F.btrim(t, F.lit(" \t\n\v\f\r")))
    return _once(text, lambda t: _once(ends(t), trim))


def content_id(*parts: Column, length: int = 24) -> Column:
    """The first hex digits of the SHA-256 of the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def nfkc(text: Column) -> Column:
    """Compatibility normalisation by an Arrow-batched function, as Spark has none."""

    def normalise(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        for t in texts:
            yield t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(normalise, StringType())(text)


def tenant_id(raw: Column) -> Column:
    """A tenant's normal id: compatibility forms folded, trimmed, lower-cased; null for an empty or unsafe one."""
    t = F.lower(F.regexp_replace(nfkc(raw), r"^\s+|\s+$", ""))
    return F.when((t != "") & ~t.rlike(r"[\p{Cc}\p{Cf}/\\]|\.\."), t)
