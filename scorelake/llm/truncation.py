"""Subtitle texts cut off by a field limit of their source or in transfer.

One pass reads each whole text and keeps a few facts of it: its lengths, how its last cue ends,
whether it uses punctuation at all, and how it would end were it cut at a place drawn by a hash. From
all texts of a source follow its candidate limits (lengths, in characters or UTF-8 bytes, at which far
more texts end than nearby) and a log-normal distribution of its lengths, in the unit of its limits,
fitted by maximum likelihood with the texts at a limit as right-censored. The fit gives each text at a
limit its posterior of being censored; off the limits the rate of cuts in transfer takes its place.

What an ending says is measured as well. How often cuts end in each way is counted over the drawn
cuts, how often whole texts do over the texts off the limits, less the cuts among them. The rate of
those comes from endings that whole texts hardly have; of such an ending, what exceeds the share
that drawn cuts have by more than chance is a habit of whole texts. Log odds of the
censoring and log likelihood ratio of the ending add up, and a text is called cut where the sum is
positive. Copies of a text count once in every statistic (lengths and shares: equal texts of a source;
lines and words: equal cues), and all get its verdict.

Endings: ``structure`` (the last cue has only its number or a time line, or an unfinished one),
``open`` (markup, bracket or song without its end), ``bare`` (no closing mark), ``trail`` (a dash or
dots, as speakers trail off or are broken off, or as a mark behind a cut), ``whole`` (a closing mark),
``blank``. A bare ending is ``closing`` (credit, title, advert) if many texts end by that very line,
seldom by a longer one that starts alike, and its last word ends fewer cues with a closing mark. Bare
endings of texts without punctuation are told apart by the last word: ``unknown_word`` (no cue of any
text has it), ``inner_word`` (hardly ever ends a cue), ``unpunctuated``; trailing ones likewise:
``trail_never`` (the word ends no cue by habit), ``trail``. By the definition of a cut text a cue must
break off, so drawn cuts that happen to fall behind a closing mark aren't counted. Lines and words are
compared without the usual misreadings of character recognition and with wrong encodings undone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.storage import materialize, release

#: A limit needs this many texts, and this many times those expected from the lengths around.
LIMIT_TEXTS, LIMIT_EXCESS = 5, 12.0
#: Texts by which a source's rate of transfer cuts and its endings lean on those of all sources.
LEAN_RATE, LEAN_ENDINGS = 100.0, 50.0
#: A text at a limit is there by its own length in at least this share of cases; an ending that no drawn cut has comes with a cut this seldom.
LEAST_NATURAL, LEAST_SEEN = 0.005, 1e-4
#: What shows a break; other endings of drawn cuts don't count. Whole texts end by the anchors as an exception only.
BREAKS = ("structure", "open", "bare", "unknown_word", "inner_word", "unpunctuated")
ANCHORS = BREAKS[:4]
#: A closing line ends at least this many texts, and this share of the texts that end by a line with the same beginning.
CLOSING_TEXTS, CLOSING_SHARE = 3, 0.2
#: Beginnings up to so many letters are counted one by one; longer lines are compared within those that share so many.
START = 200
#: A word that ends less than one in so many cues ends none by habit.
RARE = 50_000

_BLANK = " \t\r\n\f\v\x00\x85 ​　﻿"
_TIME = re.compile(r"\d{1,3}:\d\d(?::\d\d)?[.,]\d{3}[ \t]*-->[ \t]*\d{1,3}:\d\d(?::\d\d)?[.,]\d{3}(?:[ \t]+[a-z]+:\S+)*[ \t]*$")
_PART_OF_TIME = re.compile(r"[\d:.,]*\d[\d:.,]*(?:[ \t]*-{0,2}>?[ \t]*[\d:.,]*)?(?:[ \t]+[a-z]+:?\S*)*(?:\.\.\.|…)?$")
_CLOSE = re.compile(r"(?:[.!?。！？‥؟।♪♫\])}）］】」』»”\"’'>‹›*]|[=~*#|_]-+)$")
_TRAIL = re.compile(r"(?:\.\.\.?|…|—|–|(?<![=~*#|_-])--?|[\x85\x96\x97])[\"'”’»)\]]*$")
_MARK = re.compile(r"(?:\.\.\.|…|&hellip;?)$")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>|\{\\[^{}]*\}")
# What single-byte readings make of the closing marks' UTF-8 bytes.
_MISREAD_CLOSE = ("ã€‚", "ã\x80\x82", "πÇé", "ï¼\x81", "ï¼�", "∩╝ü", "ï¼Ÿ", "ï¼\x9f", "∩╝ƒ", "â™ª", "â\x99ª", "ΓÖ¬", "ï¼‰", "ï¼\x89", "∩╝ë", "ï¼½", "∩╝╜")
_MISREAD_TRAIL = ("â€¦", "â\x80¦", "ΓÇª", "â€”", "â\x80\x94", "ΓÇö", "â€“", "ΓÇô")
_WORD = re.compile(r"\w+")
_ADDRESS = re.compile(r"\.[a-z]{2,8}\b|http")
_PAIRS = (("(", ")"), ("[", "]"), ("（", "）"), ("［", "］"))


# The characters of code page 1252 outside Latin-1, by their bytes.
_1252 = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _reread(text: str) -> str:
    """Text whose UTF-8 bytes were read as single-byte characters, once or repeatedly, read rightly."""
    for _ in range(3):
        if text.isascii():
            break
        for encoding in ("latin-1", "cp437"):
            try:
                again = (text.translate(_1252) if encoding == "latin-1" else text).encode(encoding).decode("utf-8")
            except UnicodeError:
                continue
            text = again
            break
        else:
            break
    return text


# Letters and what character recognition makes of them, as one form for both.
_ALIKE = str.maketrans({"m": "rn", "d": "el", "h": "ll", "w": "vv", "0": "o", "1": "l", "i": "l", "c": "e"})


@lru_cache(maxsize=100_000)
def _look(word: str) -> str:
    """One form for letters that character recognition mixes up."""
    return word.translate(_ALIKE)


def _last_word(line: str) -> str:
    """The word at the end of a line, wrong encodings undone; of scripts without spaces its last three characters."""
    if not line.isascii():
        line = _reread(line)
    words = _WORD.findall(line[-80:].lower())
    if not words or line[-80:-79].isalnum() or line[-80:-79] == "_" or len(words) == 1:  # the word may start further left
        words = _WORD.findall(line.lower())
    if words and line.isascii():
        return _look(words[-1])
    if not words or re.search("[ÃÂÐÑâã€�]", line[-4:]):  # nothing, or lossy encoding
        return ""
    return words[-1][-3:] if words[-1][-1] >= "\u3000" else _look(words[-1])


def _aside(line: str) -> bool:
    """Sounds, songs and adverts."""
    return line[:1] in "[(（［♪" or ("." in line[:-1] or "http" in line) and bool(_ADDRESS.search(line))


def _closes(line: str) -> str:
    """trail, whole or bare: how a line ends, wrong encodings undone."""
    line = line.rstrip(_BLANK)
    if line[-1:] in ("!", "?") or line[-1:] == "." != line[-2:-1]:  # most lines
        return "whole"
    plain = re.sub(r"&hellip;?$", "…", _MARKUP.sub("", line).rstrip(_BLANK))
    for text in (plain, _reread(plain)):
        if _TRAIL.search(text) or text.endswith(_MISREAD_TRAIL):
            return "trail"
        if _CLOSE.search(text) or text.endswith(_MISREAD_CLOSE):
            return "whole"
    return "bare"


def _base(line: str) -> str:
    """A closing line without version or name at its end, in lower case."""
    return re.sub(r"(?:\s+v\d+[.\d]*|\s*[/,]\s*\S+)$", "", _MARKUP.sub("", line).strip(_BLANK).lower())


def _skeleton(line: str) -> str:
    """``_base`` without digits, blanks and punctuation."""
    line = _base(line)
    return _look("".join(c for c in re.sub(r"(?<![^\W\d])\d+(?![^\W\d])", "9", line) if c.isalnum()))


def _told(cues: list[list[str] | None]) -> bytes:
    """128 bits of what cues say, without numbers, times and blocks between them."""
    return md5("\n\n".join("\n".join(c) for c in cues if c).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def _cue(block: str) -> list[str] | None:
    """The lines of a cue; None: the block is none."""
    lines = block.split("\n")
    at = next((i for i, x in enumerate(lines[:2]) if _TIME.match(x)), None)
    return None if at is None else [x for x in lines[at + 1 :] if x.strip(_BLANK)]


def _tail(blocks: list[str], cues: list[list[str] | None]) -> tuple[str, str, str, str, int]:
    """(kind, skeleton of the last line, last word, last word of the line without version or name, number of cues in front) of blocks with at least one cue."""
    last = len(cues) - 1
    while cues[last] is None:
        lines = blocks[last].split("\n")
        if (lines[0].isdigit() and len(lines) <= 2 and all(_PART_OF_TIME.match(x) for x in lines[1:])) or (len(lines) == 1 and _PART_OF_TIME.match(lines[0])):
            return "structure", "", "", "", last
        last -= 1  # a footer behind the last cue
    final = cues[last]
    if not final:
        return "structure", "", "", "", last
    seen = _reread(" ".join(final))
    stripped = _MARK.sub("", seen.rstrip(_BLANK))
    kind, before = _closes(" ".join(final)), re.sub(r"\s*[\[(（［][^\[\]()（）［］]*[\])）］]\s*$", "", seen)
    if kind == "whole" and before != seen and before.strip(_BLANK) and _closes(before) == "bare":
        kind, seen, stripped = "bare", before, before  # a remark behind the break
    if re.search(r"(?:^|[:\])）］])\s*-$", final[-1].strip(_BLANK)) or re.search(r"<(?:/?[a-zA-Z][^<>]*|/)?$", stripped) or any(len(re.findall(rf"<{t}>", seen)) > len(re.findall(rf"</{t}>", seen)) for t in ("i", "b", "u")):
        kind = "open"
    elif any(stripped.rfind(a) > stripped.rfind(b) for a, b in _PAIRS) and kind != "whole":
        kind = "open"
    elif seen.count("♪") == 1 and seen.lstrip(_BLANK + "-").startswith("♪") and kind != "whole":
        kind = "open"
    line_word = _last_word(_base(seen))
    return kind, _skeleton(seen), _last_word(_MARK.sub("", _MARKUP.sub("", seen).rstrip(_BLANK))), "" if re.search(r"\d", line_word) else line_word, last


def _drawn(blocks: list[str], cues: list[list[str] | None], draw: float) -> tuple[str, str, str, str]:
    """``_tail`` of the text cut at the share ``draw`` of its characters."""
    at = int(draw * sum(len(b) + 2 for b in blocks))
    n = 0
    while at >= len(blocks[n]) + 2:
        at -= len(blocks[n]) + 2
        n += 1
    part = blocks[n][:at].rstrip(_BLANK)
    front, heads = (blocks[:n] + [part], cues[:n] + [_cue(part)]) if part else (blocks[:n], cues[:n])
    return _tail(front, heads)[:4] if any(c is not None for c in heads) else ("blank", "", "", "")


Ending = tuple[str, str, bool, str, str, list[str], list[str], bytes, str, str, str, str]


def ending(text: str | None) -> Ending:
    """(kind, skeleton of the last line, text has punctuation, last word, last word of the line without version or name, words that end its other cues with a closing mark, words within cues of a text without punctuation, hash of the cues before the last), then kind, skeleton and both words of the text cut at a place drawn by that hash."""
    body = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip(_BLANK)
    blocks = [b.strip(_BLANK) for b in re.split(r"\n[ \t]*\n", body)]
    cues = [_cue(b) for b in blocks]
    if not any(c is not None for c in cues):
        numbers = blocks[-1].split("\n")
        unfinished = len(numbers) > 1 and numbers[0].isdigit() and _PART_OF_TIME.match(numbers[-1])
        return ("structure" if unfinished else "blank"), "", True, "", "", [], [], _told([]), "blank", "", "", ""
    spoken = [" ".join(c) for c in cues[:-1] if c]
    closed = [_closes(s) != "bare" for s in spoken]
    words = [c for s, c in zip(spoken, closed) if not _aside(s)]
    punctuated = not words or sum(words) >= 0.4 * len(words)
    ends = [w for s, c in zip(spoken, closed) if c and not _aside(s) and (w := _last_word(s))]
    within = [_look(w) for s in spoken for w in re.findall(r"\w+", s.lower())[:-1]] if not punctuated else []
    kind, skeleton, word, line_word, last = _tail(blocks, cues)
    told = _told(cues[:last])
    drawn = _drawn(blocks, cues, int.from_bytes(told[:6], "big") / 2**48)
    return kind, skeleton, punctuated, word, line_word, ends, within if kind != "structure" else [], told, *drawn


_KEPT = ["row_id", "doc_id", "source", "chars", "bytes", "text_hash"]
_FACTS = {
    "kind": pa.string(), "skeleton": pa.string(), "punctuated": pa.bool_(), "last_word": pa.string(), "line_word": pa.string(), "ends": pa.list_(pa.string()), "within": pa.list_(pa.string()), "told": pa.binary(),
    "drawn_kind": pa.string(), "drawn_skeleton": pa.string(), "drawn_word": pa.string(), "drawn_line_word": pa.string(),
}


def text_facts(documents: DataFrame) -> DataFrame:
    """Stored rows (row_id, doc_id, source, chars, bytes, text_hash and what ``ending`` gives), with own (the first row of its text in its source) and first (the first row of all with its cues)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            facts = [ending(x) for x in b.column("text").to_pylist()]
            columns = [pa.array([f[i] for f in facts], t) for i, t in enumerate(_FACTS.values())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _KEPT), *columns], [*_KEPT, *_FACTS])

    source = F.coalesce(F.lower(F.btrim("source", F.lit(_BLANK))), F.lit(""))
    text = F.col("text").cast("string")
    slim = documents.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.char_length(text), F.lit(0)).alias("chars"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("text_hash"), text.alias("text"))
    kinds = {pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}
    schema = "row_id long, doc_id long, source string, chars int, bytes int, text_hash binary, " + ", ".join(f"{n} {kinds.get(t, 'array<string>')}" for n, t in _FACTS.items())
    read = materialize(slim.mapInArrow(run, schema), "read")
    firsts = lambda keys, out: read.groupBy(*keys).agg(F.min(F.struct("doc_id", "row_id")).alias("f")).select("f.row_id", F.lit(True).alias(out))
    marked = read.join(firsts(["source", "text_hash"], "own"), "row_id", "left").join(firsts(["told"], "first"), "row_id", "left")
    facts = materialize(marked.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("own", "first")}), "facts")
    release(read)
    return facts


def candidate_limits(facts: DataFrame) -> DataFrame:
    """Rows (source, unit, limit_at, texts, expected): lengths at which far more texts of a source end than at those around.

    Copies of a text in its source count once. Byte limits take in up to 3 bytes less, as a character that doesn't fit is dropped whole.
    Of two limits that the same texts fill (in characters and in bytes, or in bytes within 3) the one with more texts stays.
    """
    length = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    counts = facts.where("own AND chars > 0").select("source", length.alias("l")).groupBy("source", "l.unit", "l.length").agg(F.count("*").alias("n"))
    # Texts of similar length, by steps of a tenth: how many there are per unit of length.
    step = F.floor(F.log("length") / np.log(1.1))
    bands = counts.groupBy("source", "unit", step.alias("band")).agg(F.sum("n").alias("m"), F.max("n").alias("top"), F.count("*").alias("lengths"))
    width = F.exp((F.col("band") + 1) * np.log(1.1)) - F.exp(F.col("band") * np.log(1.1))
    density = bands.select("source", "unit", "band", ((F.col("m") - F.col("top") + 1) / width).alias("density"))
    peaks = counts.withColumn("band", step).where(F.col("n") >= LIMIT_TEXTS).join(density, ["source", "unit", "band"])
    high = materialize(peaks.where(F.col("n") >= LIMIT_EXCESS * F.col("density")).select("source", "unit", F.col("length").alias("limit_at"), F.col("n").alias("texts"), F.col("density").alias("expected")), "high")
    # Pairs of limits that the same texts fill.
    chars = high.where("unit = 'chars'").select("source", F.col("limit_at").alias("chars"), F.col("texts").alias("c_texts"))
    in_bytes = high.where("unit = 'bytes'")
    by_bytes = in_bytes.select("source", F.explode(F.sequence(F.col("limit_at") - 3, F.col("limit_at"))).alias("bytes"), F.col("limit_at").alias("b_limit"), F.col("texts").alias("b_texts"))
    both = facts.where("own").select("source", "chars", "bytes").join(chars, ["source", "chars"]).join(by_bytes, ["source", "bytes"])
    same = both.groupBy("source", "chars", "c_texts", "b_limit", "b_texts").agg(F.count("*").alias("m")).where("2 * m >= least(c_texts, b_texts)")
    weaker = same.select("source", F.when(F.col("b_texts") > F.col("c_texts"), F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("limit_at"))).otherwise(F.struct(F.lit("bytes").alias("unit"), F.col("b_limit").alias("limit_at"))).alias("w"))
    lower = by_bytes.select("source", F.col("bytes").alias("limit_at"), "b_limit", "b_texts").join(in_bytes.select("source", "limit_at", "texts"), ["source", "limit_at"]).where("limit_at < b_limit")
    nearby = lower.select("source", F.struct(F.lit("bytes").alias("unit"), F.when(F.col("texts") > F.col("b_texts"), F.col("b_limit")).otherwise(F.col("limit_at")).alias("limit_at")).alias("w"))
    gone = weaker.unionByName(nearby).select("source", "w.unit", "w.limit_at").distinct()
    return high.join(gone, ["source", "unit", "limit_at"], "left_anti")


def at_limit(facts: DataFrame, limits: DataFrame) -> DataFrame:
    """``facts`` with unit and limit_at: the candidate limit of its source that a text fills, or nulls."""
    small = limits.select("source", "unit", "limit_at")
    chars = small.where("unit = 'chars'").select("source", F.col("limit_at").alias("chars"), F.col("limit_at").alias("by_chars"))
    spread = F.explode(F.sequence(F.col("limit_at") - 3, F.col("limit_at")))
    by_bytes = small.where("unit = 'bytes'").select("source", spread.alias("bytes"), F.col("limit_at").alias("by_bytes")).groupBy("source", "bytes").agg(F.min("by_bytes").alias("by_bytes"))
    # Texts without a source may come from any.
    any_chars = chars.select("chars", F.col("by_chars").alias("any_chars")).distinct()
    any_bytes = by_bytes.groupBy("bytes").agg(F.min("by_bytes").alias("any_bytes"))
    joined = facts.join(chars, ["source", "chars"], "left").join(by_bytes, ["source", "bytes"], "left").join(any_chars, "chars", "left").join(any_bytes, "bytes", "left")
    limit = lambda unit, c, where: F.when(F.col(c).isNotNull() & where, F.struct(F.lit(unit).alias("unit"), F.col(c).alias("limit_at")))
    lone, every = F.col("source") == "", F.lit(True)
    found = F.coalesce(limit("chars", "by_chars", every), limit("bytes", "by_bytes", every), limit("chars", "any_chars", lone), limit("bytes", "any_bytes", lone))
    return joined.withColumn("found", found).select(*facts.columns, "found.unit", "found.limit_at")


def _fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Log-normal by expectation-maximization for right-censored values; one row per source and unit in and out."""
    from math import erfc, exp, log, pi, sqrt

    tail = lambda z: max(0.5 * erfc(z / sqrt(2)), 1e-12)
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            n, s, q = r.n, r.s, r.q
            mu = s / n if n else 6.0
            sd = sqrt(max(q / n - mu * mu, 1e-4)) if n else 1.0
            cut = [(log(c["limit_at"]), c["texts"]) for c in r.censored]
            for _ in range(200 if cut else 0):
                es, eq, en = s, q, n
                for c, k in cut:
                    z = (c - mu) / sd
                    hazard = exp(-z * z / 2) / sqrt(2 * pi) / tail(z)
                    mean = mu + sd * hazard
                    es += k * mean
                    eq += k * (mean * mean + sd * sd * (1 + z * hazard - hazard * hazard))
                    en += k
                new = es / en
                sd, moved = sqrt(max(eq / en - new * new, 1e-4)), abs(new - mu)
                mu = new
                if moved < 1e-7:
                    break
            rows.append((r.source, r.unit, float(mu), float(sd), int(n + sum(k for _, k in cut))))
        yield pd.DataFrame(rows, columns=["source", "unit", "mu", "sd", "texts"])


def length_models(placed: DataFrame) -> DataFrame:
    """Rows (source, unit, mu, sd, texts): the maximum-likelihood log-normal of each source's lengths, in characters and in bytes; texts at a limit are censored in its unit and left out of the other."""
    used = placed.where("own AND chars > 0")
    free = used.where(F.col("limit_at").isNull()).select("source", F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.log(u).alias("x")) for u in ("chars", "bytes")))).alias("l"))
    sums = free.groupBy("source", "l.unit").agg(F.count("*").alias("n"), F.sum("l.x").alias("s"), F.sum(F.col("l.x") * F.col("l.x")).alias("q"))
    cut = used.where(F.col("limit_at").isNotNull()).groupBy("source", "unit", "limit_at").agg(F.count("*").alias("texts"))
    lists = cut.groupBy("source", "unit").agg(F.collect_list(F.struct("limit_at", "texts")).alias("censored"))
    none = F.array().cast("array<struct<limit_at:int,texts:bigint>>")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    joined = sums.join(lists, ["source", "unit"], "full_outer").select("source", "unit", zero("n", 0), zero("s", 0.0), zero("q", 0.0), F.coalesce("censored", none).alias("censored"))
    return joined.mapInPandas(_fit, "source string, unit string, mu double, sd double, texts long")


def closing_lines(facts: DataFrame) -> DataFrame:
    """Rows (skeleton, closing_texts): lines without a closing mark by which different texts end as a habit; ``facts`` of texts that fill no limit."""
    texts = facts.where((F.col("kind") == "bare") & (F.col("skeleton") != "")).select("skeleton", "told").distinct()
    keys = materialize(texts.groupBy("skeleton").agg(F.count("*").alias("n")), "endings")
    enough = keys.where(F.col("n") >= CLOSING_TEXTS)
    long = F.length("skeleton") > START
    # Only beginnings as long as a line in question are looked at; those are START lengths at most.
    lengths = [r[0] for r in enough.where(~long).select(F.length("skeleton")).distinct().collect()]
    within = F.filter(F.array(*map(F.lit, sorted(lengths))), lambda k: k <= F.length("skeleton")) if lengths else F.array().cast("array<int>")
    starts = keys.select(F.explode(within).alias("k"), "skeleton", "n")
    alike = starts.groupBy(F.substring("skeleton", F.lit(1), F.col("k")).alias("skeleton")).agg(F.sum("n").alias("alike"))
    others = keys.where(long).select(F.substring("skeleton", 1, START).alias("start"), F.col("skeleton").alias("other"), F.col("n").alias("m"))
    longer = enough.where(long).withColumn("start", F.substring("skeleton", 1, START)).join(others, "start").where(F.startswith("other", "skeleton")).groupBy("skeleton", "n").agg(F.sum("m").alias("alike"))
    judged = enough.where(~long).join(alike, "skeleton").unionByName(longer)
    return judged.where(F.col("n") >= CLOSING_SHARE * F.col("alike")).select("skeleton", F.col("n").alias("closing_texts"))


def _ways(endings: DataFrame, closing: DataFrame, words: DataFrame, rare: float) -> DataFrame:
    """``endings`` (kind, skeleton, punctuated, last_word, line_word and others) with way, the ending told apart by closing lines and words, and marked, what a mark behind it would make of it."""
    named = endings.withColumns({c: F.nullif(c, F.lit("")) for c in ("skeleton", "last_word", "line_word")})  # "" would be a hot key
    rows = named.join(closing, "skeleton", "left").join(words, "last_word", "left").join(words.select(F.col("last_word").alias("line_word"), F.col("ends").alias("line_ends")), "line_word", "left")
    habit = F.col("closing_texts").isNotNull() & (F.col("line_word").isNull() | (F.coalesce("line_ends", F.lit(0)) < F.col("closing_texts")))
    inner = (F.col("uses") >= 20) & (F.col("ends") < 0.01 * F.col("uses"))
    bare = F.when(habit, "closing").when(F.col("punctuated"), "bare").when(F.col("uses").isNull(), "unknown_word").when(inner, "inner_word").otherwise("unpunctuated")
    trail = F.when(F.col("last_word").isNotNull() & (F.coalesce("ends", F.lit(0)) < rare), "trail_never").otherwise("trail")
    way = F.when(F.col("kind") == "bare", bare).when(F.col("kind") == "trail", trail).otherwise(F.col("kind"))
    marked = F.when((F.col("kind") == "bare") & (way != "closing"), trail).otherwise(way)
    return rows.select(*endings.columns, way.alias("way"), marked.alias("marked"))


def _weights(counts: DataFrame, drawn: DataFrame, censored: DataFrame) -> DataFrame:
    """Rows (source, unit, limit_at, punctuated, way, log_odds) of all that occur; unit and limit_at are null off the limits.

    ``counts``: source, unit, limit_at, punctuated, way, n of different texts; ``drawn``: punctuated, way,
    marked, n of drawn cuts that show a break; ``censored``: source, unit, limit_at, censored. All are
    counts by source, small beside the texts.
    """
    off = counts.where(F.col("limit_at").isNull())
    share = lambda c: drawn.groupBy("punctuated", F.col(c).alias("way")).agg(F.sum("n").alias("d")).join(drawn.groupBy("punctuated").agg(F.sum("n").alias("all")), "punctuated").select("punctuated", "way", (F.col("d") / F.col("all")).alias("c_" + c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cuts = share("way").join(share("marked"), ["punctuated", "way"], "full_outer").select("punctuated", "way", zero("c_way").alias("c0"), zero("c_marked").alias("c1"))
    at = lambda c, way: F.max(F.when(F.col("way") == way, F.col(c)))
    anchors = cuts.groupBy("punctuated").agg(F.sum(F.when(F.col("way").isin(*ANCHORS), F.col("c0"))).alias("c_anchor"), at("c1", "trail_never").alias("c_never"), F.sum(F.when(F.col("way").startswith("trail"), F.col("c1"))).alias("c_trail"))
    # Rates of cuts off the limits and of marks behind them, over all sources.
    n = lambda *ways: F.sum(F.when(F.col("way").isin(*ways), F.col("n")).otherwise(0))
    beyond = lambda seen, cuts: F.greatest(seen - cuts - F.when(cuts > 0, 2 * F.sqrt(seen)).otherwise(0.0), F.lit(0.0))
    pooled = off.groupBy("punctuated").agg(F.sum("n").alias("texts"), n(*ANCHORS).alias("broken"), n("trail_never").alias("never")).join(anchors, "punctuated", "left")
    rate = F.least(F.lit(0.5), F.coalesce(F.try_divide(F.col("broken"), F.col("texts") * F.col("c_anchor")), F.lit(0.0)))
    pooled = pooled.withColumn("rate", F.greatest(rate, 0.5 / (F.col("texts") + 1)))
    pooled = pooled.withColumn("mark", F.least(F.lit(0.5), F.coalesce(F.try_divide(F.col("never"), F.col("texts") * F.col("rate") * F.col("c_never")), F.lit(0.0))))
    ways = counts.groupBy("punctuated", "way").agg(F.sum(F.when(F.col("limit_at").isNull(), F.col("n")).otherwise(0)).alias("seen")).join(cuts, ["punctuated", "way"], "left").join(pooled, "punctuated", "left")
    ways = ways.select("*", zero("c0").alias("p0"), zero("c1").alias("p1")).drop("c0", "c1")
    cut = (1 - F.col("mark")) * F.col("p0") + F.col("mark") * F.col("p1")
    whole = F.try_divide(beyond(F.col("seen"), F.col("texts") * F.col("rate") * cut) + 0.5, F.col("texts") * (1 - F.col("rate")) + 1)
    ways = materialize(ways.select("punctuated", "way", "p0", "p1", cut.alias("cut"), "rate", "c_anchor", "c_trail", F.coalesce(whole, F.lit(0.5)).alias("whole")), "ways")
    # The same by source, leaning on all sources.
    own = off.groupBy("source", "punctuated").agg(F.sum("n").alias("texts"), n(*ANCHORS).alias("broken"))
    pairs = counts.select("source", "punctuated").distinct().join(own, ["source", "punctuated"], "left").join(ways, "punctuated").join(off.select("source", "punctuated", "way", F.col("n").alias("seen")), ["source", "punctuated", "way"], "left")
    texts = zero("texts")
    mine = F.least(F.lit(0.5), F.coalesce(F.try_divide(zero("broken") + LEAN_RATE * F.col("rate") * F.col("c_anchor"), (texts + LEAN_RATE) * F.col("c_anchor")), F.col("rate"), F.lit(0.0)))
    pairs = pairs.withColumn("mine", F.greatest(mine, F.lit(LEAST_SEEN)))
    usual = (beyond(zero("seen"), texts * F.col("mine") * F.col("cut")) + LEAN_ENDINGS * F.col("whole")) / (texts * (1 - F.col("mine")) + LEAN_ENDINGS)
    pairs = materialize(pairs.select("source", "punctuated", "way", "p0", "p1", "cut", "mine", "c_trail", usual.alias("usual")), "usual")
    ratio = lambda c: F.log(F.greatest(c, F.lit(LEAST_SEEN)) / F.col("usual"))
    free = pairs.select("source", F.lit(None).cast("string").alias("unit"), F.lit(None).cast("int").alias("limit_at"), "punctuated", "way", (F.log(F.col("mine") / (1 - F.col("mine"))) + ratio(F.col("cut"))).alias("log_odds"))
    # At a limit: the posterior of the length, and the limit's own habit of marks.
    trailing = pairs.where(F.col("way").startswith("trail")).groupBy("source", "punctuated").agg(F.sum("usual").alias("w_trail"), F.first("c_trail").alias("c_trail"))
    full = counts.where(F.col("limit_at").isNotNull()).groupBy("source", "unit", "limit_at", "punctuated").agg(F.sum("n").alias("here"), F.sum(F.when(F.col("way").startswith("trail"), F.col("n")).otherwise(0)).alias("trails"))
    full = full.join(censored, ["source", "unit", "limit_at"], "left").join(trailing, ["source", "punctuated"], "left")
    full = full.withColumn("p", F.least(F.lit(1 - LEAST_NATURAL), F.greatest(F.lit(0.01), zero("censored"))))
    habit = F.try_divide((F.col("trails") - F.col("here") * (1 - F.col("p")) * zero("w_trail")) / (F.col("here") + 5), F.col("p") * F.col("c_trail"))
    full = full.select("source", "unit", "limit_at", "punctuated", "p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(habit, F.lit(0.0)))).alias("mark"))
    filled = full.join(pairs, ["source", "punctuated"])
    marked = (1 - F.col("mark")) * F.col("p0") + F.col("mark") * F.col("p1")
    filled = filled.select("source", "unit", "limit_at", "punctuated", "way", (F.log(F.col("p") / (1 - F.col("p"))) + ratio(marked)).alias("log_odds"))
    return free.unionByName(filled)


def score(documents: DataFrame, lengths: bool = True) -> DataFrame:
    """Rows (doc_id, source, chars, kind, unit, limit_at, censored, log_odds, cut) of all documents; kind is the ending told apart.

    Null, empty and blank texts are whole. Texts of any length are read whole; copies count once
    in what texts are held against and are judged alike. A source is told apart without case and surrounding blanks; texts
    of a null source are held against the limits of all sources. ``lengths=False`` judges as if no text filled a limit.
    """
    facts = text_facts(documents)
    limits = materialize(candidate_limits(facts), "limits")
    placed = at_limit(facts, limits if lengths else limits.limit(0))
    models = length_models(placed)
    at = placed.where(F.col("own") & F.col("limit_at").isNotNull()).groupBy("source", "unit", "limit_at").agg(F.count("*").alias("here"))
    # Censored texts are expected at the mass beyond the limit, others at the density there (a byte limit takes in four lengths); a text is at the limit for either reason.
    z = (F.log("limit_at") - F.col("mu")) / F.col("sd")
    natural = F.col("texts") * F.exp(-z * z / 2) / (F.sqrt(F.lit(2 * np.pi)) * F.col("sd") * F.col("limit_at")) * F.when(F.col("unit") == "bytes", 4).otherwise(1)
    censored = materialize(at.join(models, ["source", "unit"]).select("source", "unit", "limit_at", F.greatest(F.lit(0.0), 1 - natural / F.greatest(F.col("here"), F.lit(1))).alias("censored")), "censored")
    closing = closing_lines(placed.where(F.col("limit_at").isNull()))
    one = lambda c, ends: facts.where("first").select(F.explode(c).alias("last_word"), F.lit(ends).alias("e"))
    words = one("ends", 1).unionAll(one("within", 0)).groupBy("last_word").agg(F.count("*").alias("uses"), F.sum("e").alias("ends"))
    words = materialize(words, "words")
    rare = max(1.0, (words.agg(F.sum("ends")).first()[0] or 0) / RARE)
    columns = ["doc_id", "source", "chars", "own", "unit", "limit_at", "punctuated", "kind", "skeleton", "last_word", "line_word"]
    rows = _ways(placed.select(*columns), closing, words, rare)
    rows = materialize(rows.select("doc_id", "source", "chars", "own", "unit", "limit_at", "punctuated", F.col("way").alias("kind")), "judged")
    cuts = facts.where("own AND drawn_kind <> 'blank'").select("punctuated", F.col("drawn_kind").alias("kind"), F.col("drawn_skeleton").alias("skeleton"), F.col("drawn_word").alias("last_word"), F.col("drawn_line_word").alias("line_word"))
    drawn = _ways(cuts, closing, words, rare).where(F.col("way").isin(*BREAKS)).groupBy("punctuated", "way", "marked").agg(F.count("*").alias("n"))
    counts = rows.where("own").groupBy("source", "unit", "limit_at", "punctuated", F.col("kind").alias("way")).agg(F.count("*").alias("n"))
    weights = _weights(materialize(counts, "counts"), materialize(drawn, "drawn"), censored)
    here = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("source", "unit", "limit_at", "punctuated")]
    scored = rows.alias("r").join(weights.alias("w"), [*here, F.col("r.kind") == F.col("w.way")], "left")
    whole = F.col("kind").isin("whole", "blank", "closing")
    odds = F.when(whole, F.least(F.lit(-1.0), F.col("log_odds"))).otherwise(F.coalesce("log_odds", F.lit(0.0)))
    named = scored.select("r.doc_id", "r.source", "r.chars", "r.kind", "r.unit", "r.limit_at", odds.alias("log_odds"))
    return named.join(censored, ["source", "unit", "limit_at"], "left").select("doc_id", "source", "chars", "kind", "unit", "limit_at", "censored", "log_odds", (F.col("log_odds") > 0).alias("cut"))


def source_rates(scored: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, their share, and how many of them fill a limit."""
    return scored.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut_texts"), F.count_if(F.col("cut") & F.col("limit_at").isNotNull()).alias("cut_at_limit")).withColumn("cut_rate", F.col("cut_texts") / F.col("texts"))
