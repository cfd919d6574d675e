"""Secrets in texts: three fixed patterns, and strings that look random by two character Markov models.

The models are bigram tables over classes of characters, one for random strings and one for ordinary identifiers. They
are counted over all documents. Random ones are the values that the fixed patterns find in them, and base-64
forms of ``MADE`` hashes; ordinary ones are the other words, single and joined, up to the length of a candidate. Counts
start at one. A candidate is a run of token characters with a letter; it is a secret if the log-likelihood ratio of the
two models is at least ``MARGIN`` per character. Names in mixed case look more random than other words, so a candidate
without a digit needs ``LETTERS_SHARE`` of the ratio that the models give to letters drawn evenly.

Everything here is Catalyst expressions: no Python runs on the executors.

Positions are code points. A null text counts as empty and has no secrets; an empty table gives no rows. Rows that repeat
are reported as often. ``redacted`` replaces each span and passes all columns through; spans that overlap become one.
Other columns are not read. Spans of a text are worked on in parts of ``PART``, so that time grows about as its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.samples import fresh

# fixed values: the patterns of the contract, and the least length of what counts of a match
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]+)"
KINDS = [("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24)]

#: characters of a candidate, and how many
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: log-likelihood ratio per character from which a candidate is a secret
MARGIN = 0.35
#: for candidates without a digit: share of the mean ratio over all pairs of letters
LETTERS_SHARE = 0.5
#: hashes whose base-64 forms join the random sample
MADE = 500
#: classes of characters: each character of this list its own, all others one
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
_N = len(ALPHABET) + 1
REDACTION = "[SECRET]"
#: spans of a text that are worked on together
PART = 128

_SPAN = "array<struct<kind:string,start:long,end:long,rank:int,value:string>>"


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _parts(items: Column) -> Column:
    """An array in parts of ``PART``; an empty array is one empty part."""
    last = F.greatest(F.ceil(F.size(items) / PART).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * PART + 1, PART))


def _parts_of(items: Column) -> Column:
    return _with(items, _parts)


def _running(parts: Column, first: Column, after) -> Column:
    """``first``, and what ``after`` makes of the value before a part and the part, one for each part."""
    return F.aggregate(parts, F.array(first), lambda have, part: F.concat(have, F.array(after(F.element_at(have, -1), part))))


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int) -> Column:
    """Leftmost matches that do not overlap, with their places: what stands between matches gives the lengths."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    steps = F.transform(F.arrays_zip(found.alias("f"), values.alias("v"), F.slice(between, 1, F.size(found)).alias("b")),
                        lambda x: F.struct(F.length(x["b"]).cast("long").alias("gap"), F.length(x["f"]).cast("long").alias("size"), x["v"].alias("value")))

    def step(have, x):
        begin = have["at"] + x["gap"]
        end = begin + x["size"]
        return F.struct(end.alias("at"), F.concat(have["out"], F.array(F.struct(
            F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), x["value"].alias("value")))).cast(_SPAN).alias("out"))

    def placed(part, begin):
        return F.aggregate(part, F.struct(begin.alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda have: have["out"])

    def length(part):
        return F.aggregate(part, F.lit(0).cast("long"), lambda have, x: have + x["gap"] + x["size"])

    return F.flatten(_with(_parts_of(steps), lambda parts: _with(
        _running(parts, F.lit(0).cast("long"), lambda at, part: at + length(part)),
        lambda begins: F.transform(parts, lambda part, k: placed(part, F.get(begins, k))))))


def _or_none(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(_SPAN))


def _long_enough(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


def base_spans(text: Column) -> Column:
    """All matches of the fixed patterns that are long enough; a text without a needle is not searched."""
    parts = []
    for rank, (kind, pattern, least) in enumerate(KINDS):
        needle = {"assign": text.rlike(ASSIGN), "access": text.contains("AKIA"), "hex": text.rlike("[0-9a-f]{24}")}[kind]
        # shorter runs of hex digits and access keys cannot hide a longer one, so that they need not be matched
        quick = {"assign": pattern, "access": r"(AKIA[A-Z0-9]{16,})", "hex": r"([0-9a-f]{24,})"}[kind]
        parts.append(_or_none(needle, _long_enough(_spans(text, kind, rank, quick, 1), least)))
    return F.concat(*parts)


def _pairs(token: Column) -> Column:
    """Class pairs of neighbouring characters as numbers from 0; characters that are not listed are class 0."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    inner = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), inner), F.slice(codes, F.lit(2), inner), lambda a, b: a * _N + b)


def _slim(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def train(documents: DataFrame) -> list[float]:
    """Log-likelihood ratio, random against ordinary, of each pair of character classes; a bounded table."""
    slim = _slim(documents)
    plain = F.col("text")
    # candidates are not taken for ordinary, whatever they are
    for pattern in (ASSIGN, ACCESS, "[0-9a-f]{24,}", TOKEN):
        plain = F.regexp_replace(plain, pattern, " ")
    # once as they stand, and once joined as in names of several words
    forms = slim.select(plain.alias("plain")).select(F.explode(F.array("plain", F.regexp_replace("plain", " ", "_"))).alias("plain"))
    # a token falls into parts that share the underscore between them, so that the pairs stay the same and few parts differ
    tokens = F.array_join(F.regexp_extract_all("plain", F.lit("[A-Za-z_][A-Za-z0-9_-]{3,}"), F.lit(0)), " ")
    ordinary = forms.select(F.explode(F.split(F.regexp_replace(tokens, "_", "_ _"), " ")).alias("token"), F.lit(0).alias("label"))
    hits = slim.select(base_spans(F.col("text")).alias("found")).where(F.size("found") > 0)
    random = hits.select(F.explode("found.value").alias("token"), F.lit(1).alias("label"))
    made = documents.sparkSession.range(MADE).select(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))).alias("token"), F.lit(1).alias("label"))
    tokens = ordinary.union(random).union(made).groupBy("label", "token").agg(F.count("*").alias("n"))
    counts = (tokens.select("label", "n", F.explode(_pairs(F.col("token"))).alias("pair"))
              .groupBy("label", "pair").agg(F.sum("n").alias("n")).collect())
    table = [[1.0] * (_N * _N) for _ in range(2)]
    for row in counts:
        table[row["label"]][row["pair"]] += row["n"]
    chance = []
    for counted in table:
        rows = [sum(counted[i * _N:(i + 1) * _N]) for i in range(_N)]
        chance.append([math.log(counted[k] / rows[k // _N]) for k in range(_N * _N)])
    return [round(r - o, 6) for o, r in zip(*chance)]


def letters_margin(ratios: list[float]) -> float:
    """Least ratio per character of a candidate without a digit."""
    letters = range(1, 53)  # their places in the list of characters
    mean = round(math.fsum(ratios[a * _N + b] for a in letters for b in letters) / len(letters) ** 2, 6)
    return max(MARGIN, LETTERS_SHARE * mean)


def _random_spans(text: Column, ratios: list[float]) -> Column:
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")

    def secret(s):
        token = s["value"]
        total = F.aggregate(_pairs(token), F.lit(0.0), lambda have, k: have + F.get(table, k))
        margin = F.when(token.rlike("[0-9]"), MARGIN).otherwise(letters_margin(ratios))
        return token.rlike("[A-Za-z]") & (total >= margin * (F.length(token) - 1))

    return F.filter(_spans(text, "random", len(KINDS), f"({TOKEN})", 1), secret)


def with_spans(documents: DataFrame, ratios: list[float]) -> tuple[DataFrame, str, str]:
    """``documents`` with two more columns, and their names: base spans, and all spans, as (start, rank, end, kind) in order."""

    def ordered(spans: Column) -> Column:
        return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))

    base, added, both = (fresh(c, documents.columns) for c in ("base_spans", "random_spans", "all_spans"))
    whole = F.coalesce(F.col("text"), F.lit(""))
    # columns of their own, so that no part is worked out twice
    found = documents.withColumn(base, ordered(base_spans(whole)))
    found = found.withColumn(added, ordered(_or_none(whole.rlike(TOKEN), _random_spans(whole, ratios))))

    def meet(a, b):
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    ranges = F.transform(_parts(F.col(base)), lambda part: F.struct(
        F.array_min(part["start"]).alias("start"), F.array_max(part["end"]).alias("end"), part.alias("part")))
    apart = _with(ranges, lambda near: F.filter(added, lambda s: ~F.exists(
        near, lambda r: F.coalesce(meet(r, s), F.lit(False)) & F.exists(r["part"], lambda b: meet(b, s)))))
    found = found.withColumn(added, F.when(F.size(added) > 0, apart).otherwise(F.col(added)))
    return found.withColumn(both, F.when(F.size(added) > 0, F.array_sort(F.concat(base, added))).otherwise(F.col(base))).drop(added), base, both


def _said(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan(documents: DataFrame, ratios: list[float]) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every document."""
    found, base, both = with_spans(_slim(documents), ratios)
    counts = [_count_of(base, kind).alias(f"n_{kind}") for kind, _, _ in KINDS]
    return found.select("doc_id", *counts, F.sha2(_said(base), 256).alias("base_sha256"), _said(both).alias("spans"))


def redacted(documents: DataFrame, ratios: list[float]) -> DataFrame:
    """``documents`` with each secret of ``text`` replaced by ``REDACTION``; all columns stay, and n_chars follows the text."""
    columns = documents.columns
    found, _, spans = with_spans(documents, ratios)
    cut = fresh("cut", found.columns)
    text = F.col("text")

    def marked(part, begin, end):
        """The text from ``begin`` to ``end``, with its spans replaced."""
        own = F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))

        def step(piece):
            def one(have, s):
                gap = F.substring(piece, (have["at"] - begin + 1).cast("int"), F.greatest(s["start"] - have["at"], F.lit(0)).cast("int"))
                mark = F.when(s["start"] < have["at"], F.lit("")).otherwise(F.lit(REDACTION))
                return F.struct(F.greatest(s["end"], have["at"]).alias("at"), F.concat(have["out"], gap, mark).alias("out"))
            return one

        return _with(own, lambda piece: F.aggregate(part, F.struct(begin.alias("at"), F.lit("").alias("out")), step(piece), lambda have: have["out"]))

    whole = _with(_parts(F.col(spans)), lambda parts: _with(
        _running(parts, F.lit(0).cast("long"), lambda at, part: F.greatest(at, F.array_max(part["end"]))),
        lambda ends: F.concat(
            F.array_join(F.transform(parts, lambda part, k: marked(part, F.get(ends, k), F.get(ends, k + 1))), ""),
            F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.length(text)))))
    found = found.withColumn(cut, F.when(F.size(spans) > 0, whole))
    found = found.withColumn("text", F.coalesce(cut, text))
    if "n_chars" in columns:
        kind = documents.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col(cut).isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*columns)
