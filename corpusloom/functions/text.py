"""Column functions: canonical JSON, digests, pre-tokens, quality, n-grams, schedules. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer's pattern, a lossless cover of any text.
PRETOKEN = r" ?[A-Za-z]+| ?[0-9]| ?[^A-Za-z0-9\s\x0B]+|[\s\x0B]+"
#: White space as Unicode has it, written so that Java and RE2 read it alike.
SPACE = r"[ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def canonical_json(**fields: Column) -> Column:
    """Keys sorted, no spaces, nulls kept; numbers should come as strings or integers, text as ASCII, to be the same everywhere."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"})


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def document_text(lane: Column, text: Column, prompt: Column, response: Column) -> Column:
    return F.when(lane == "instruct", canonical_json(prompt=prompt, response=response)).otherwise(text)


def training_text(lane: Column, text: Column, prompt: Column, response: Column) -> Column:
    """What a tokenizer is trained on: prompt, a space and response of a pair, else the text."""
    return F.when(lane == "instruct", F.concat_ws(" ", prompt, response)).otherwise(text)


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def _clean_lines(text: Column) -> Column:
    trimmed = F.transform(F.split(text, LINE_END), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def quality_features(text: Column) -> dict[str, Column]:
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    lines = _clean_lines(text)
    return {
        "n_words": F.size(words),
        "n_distinct": F.size(F.array_distinct(F.transform(words, F.lower))),
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")),
        "n_chars": F.length(F.regexp_replace(text, SPACE, "")),
        "n_lines": F.size(lines),
        "n_distinct_lines": F.size(F.array_distinct(lines)),
    }


def quality_score(n_words, n_distinct, n_letters, n_chars, n_lines, n_distinct_lines) -> Column:
    """0 to 1, four decimals: distinct words, letters, length, less repeated lines; 0 without a word."""
    unique = n_distinct.cast("double") / n_words
    alpha = n_letters.cast("double") / F.greatest(n_chars, F.lit(1))
    length = F.least(F.lit(1.0), n_words / F.lit(30.0))
    repeated = F.when(n_lines > 1, 1.0 - n_distinct_lines.cast("double") / n_lines).otherwise(0.0)
    raw = F.lit(0.80) * unique + F.lit(0.10) * alpha + F.lit(0.10) * length - F.lit(0.40) * repeated
    return F.when(n_words == 0, 0.0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * 10000.0 + 0.5) / 10000.0)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of n tokens, joined by a unit separator; none if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), "\x1f"))
    return F.when(F.size(tokens) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def gram_hashes(tokens: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the runs of n tokens; none if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.xxhash64(F.slice(tokens, i, n)))
    return F.when(F.size(tokens) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def learning_rate(step: Column, peak: float, warmup: int, total: int) -> Column:
    """Linear warm-up, then a cosine down to a tenth of the peak."""
    part = (step - warmup) / float(max(1, total - warmup))
    return F.when(step <= warmup, F.lit(peak) * step / float(warmup)).otherwise(F.lit(peak) * (0.1 + 0.9 * 0.5 * (1.0 + F.cos(F.lit(math.pi) * part))))


def document_key(source: Column, number: Column) -> Column:
    return F.concat_ws("/", source, number.cast("string"))


def split_key(key: Column) -> tuple[Column, Column]:
    """Source and number of a document key; the source may hold slashes."""
    return F.regexp_extract(key, r"^(.*)/(\d+)$", 1), F.regexp_extract(key, r"^(.*)/(\d+)$", 2).cast("long")


def reason_kind(reason: Column) -> Column:
    return F.split_part(reason, F.lit(":"), F.lit(1))
