"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from
labelled samples by counting neighbouring symbols. A run of token characters, or a stretch of one between base
matches, is a secret where its log-likelihood ratio passes a threshold. The model is a table of (number of symbols)
squared, whatever the input. Everything runs as DataFrame functions: samples, counts, spans, scores and redaction.
Positions are running totals over arrays, in blocks of the square root of their length, since appending to an array copies
it: a text with n matches costs n ** 1.5 steps.

Null and empty texts have no spans. Repeated rows, null ids, ties and empty tables need nothing special: with no
identifiers to learn from, the ordinary model is uniform. Further columns stay, those named as an added one are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lodeframe.llm.sampling import sample_rows

#: The base patterns, as Java regular expressions, in the order in which ties are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Symbols of the models; a candidate is a run of them, or what the base spans leave of one.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Symbols between the segments of a path, a dotted name or a version.
SEPARATORS = "/._=-"
RUN = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{%d,}"
#: Random strings and documents to learn from (at most so many), least length and log-likelihood ratio of a secret.
SAMPLE_STRINGS, SAMPLE_DOCS, MIN_CHARS, MIN_RATIO = 6_000, 5_000, 20, 12.0
#: Share of the symbols of a secret that lie in segments with a positive ratio.
MIN_SHARE = 0.75
#: Least ratio for each pair that counts, unless a string is of capitals and digits.
MIN_RATE = 1.25
#: What is added to that for strings without a digit, which most compounds of words are.
WORDY = 0.25


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(array: Column) -> Column:
    return F.ceil(F.sqrt(F.size(array))).cast("int")


def _running(values: Column, merge) -> Column:
    """Running totals of an array of integers from zero on; ``merge`` is associative."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), merge)

    def inside(part: Column, base: Column) -> Column:
        return F.transform(part, lambda _, j: merge(base, total(F.slice(part, F.lit(1), j + 1))))

    def of(v: Column) -> Column:
        parts = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / n).cast("int")), lambda i: F.slice(v, i * n + 1, n))
        shifted = lambda ps: _let(F.transform(ps, total), lambda sums: F.transform(ps, lambda p, i: _let(total(F.slice(sums, F.lit(1), i)), lambda base: inside(p, base))))
        return F.flatten(_let(_let(_blocks(v), parts), shifted))

    return _let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(v))


def _pieces(text: Column, bounds: Column) -> Column:
    """The stretches of a text between neighbouring positions of a sorted array; blocks of them are cut first."""

    def inside(t: Column, p: Column) -> Column:
        whole = F.substring(t, F.get(p, F.lit(0)) + 1, F.get(p, F.size(p) - 1) - F.get(p, F.lit(0)))
        return _let(whole, lambda s: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda end, j: F.substring(s, F.get(p, j) - F.get(p, F.lit(0)) + 1, end - F.get(p, j))))

    def of(t: Column, v: Column, n: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 2) / n).cast("int")), lambda i: _let(F.slice(v, i * n + 1, n + 1), lambda p: inside(t, p))))

    return _let(text, lambda t: _let(bounds, lambda v: _let(_blocks(v), lambda n: of(t, v, n))))


def _replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with ``by(stretch, whether a span begins it)`` in place of the stretches that sorted ``spans`` cover."""

    def of(sp: Column, most: Column) -> Column:
        before = lambda i: F.coalesce(F.get(most, F.when(i > 0, i - 1)), F.lit(0))
        fresh = F.transform(sp, lambda s, i: s["start"] >= before(i))
        bounds = F.flatten(F.transform(sp, lambda s, i: F.array(F.greatest(s["start"], before(i)), F.get(most, i))))
        bounds = F.concat(F.array(F.lit(0)), bounds, F.array(F.length(text)))
        even = lambda i: F.pmod(i, F.lit(2)) == 0
        return _let(fresh, lambda f: F.array_join(F.transform(_pieces(text, bounds), lambda p, i: F.when(even(i), p).otherwise(by(p, F.get(f, ((i - 1) / 2).cast("int"))))), ""))

    whole = _let(spans, lambda sp: _let(_running(F.transform(sp, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), lambda most: of(sp, most)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end, hit) of the leftmost non-overlapping matches, in code points.

    Gaps between matches and matches alternate, so running totals of their lengths give the positions. Only texts with a
    match are split.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hit:string>>")

    def of(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: g + F.length(h))
        return F.zip_with(_running(lengths, lambda a, b: a + b), hits, lambda e, h: F.struct((e - F.length(h)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), h.alias("hit")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, of(hits)).otherwise(none))


def _places(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Sorted (start, kind, end) of the matches of the fixed patterns."""
    assign = F.filter(_spans(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 12)
    return F.array_sort(F.concat(_places(assign), _places(_spans(text, ACCESS, 1)), _places(_spans(text, HEX, 2))))


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with blanks, which are no symbols of the models, in place of all that sorted ``spans`` cover."""
    return _replaced(text, spans, lambda piece, fresh: F.repeat(F.lit(" "), F.length(piece)))


def labelled_samples(docs: DataFrame, strings: int = SAMPLE_STRINGS, doc_bound: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sample, is_random): random strings over usual alphabets, and ordinary runs of a bounded sample of documents.

    The documents are the ``doc_bound`` with the smallest hashes of id and text (``sampling``); what base matches cover, values of
    assignments included, is left out. The random strings are digests of counters, so they are the same on every run.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    alphabets = F.array(digest, F.base64(F.unhex(digest)), F.translate(F.base64(F.unhex(digest)), "+/=", "-_"), F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "")), F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", ""))
    random = spark.range(strings).select(F.get(alphabets, F.pmod("id", F.lit(5)).cast("int")).alias("sample"), F.lit(True).alias("is_random"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    some = sample_rows(rows, ["id", "t"], {"": docs.count()}, doc_bound).select("t")
    some = some.withColumn("b", base_spans(F.col("t"))).withColumn("open", blanked(F.col("t"), F.col("b")))
    ordinary = some.select(F.explode(F.regexp_extract_all("open", F.lit(RUN % 5), F.lit(0))).alias("sample"), F.lit(False).alias("is_random"))
    return random.unionByName(ordinary)


def fit_markov(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each pair of neighbouring symbols (row-major), add-one smoothed.

    Pairs with one of ``SEPARATORS`` tell nothing, and are zero: whether paths, dotted names or versions occur in the samples must
    not decide about them.
    """
    at = F.sequence(F.lit(1), F.length("sample") - 1)
    pairs = samples.where(F.length("sample") > 1).select("is_random", F.explode(F.transform(at, lambda i: F.substring(F.col("sample"), i, F.lit(2)))).alias("pair"))
    rows = pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_.=-]{2}$")).groupBy("is_random", "pair").count().collect()
    k = len(SYMBOLS)
    code = {c: i for i, c in enumerate(SYMBOLS)}
    logs = {}
    for label in (True, False):
        counts = [[1.0] * k for _ in range(k)]
        for r in rows:
            if r["is_random"] == label:
                counts[code[r["pair"][0]]][code[r["pair"][1]]] += r["count"]
        logs[label] = [math.log(c / sum(row)) for row in counts for c in row]
    told = [not {a, b} & set(SEPARATORS) for a in SYMBOLS for b in SYMBOLS]
    return [a - b if t else 0.0 for a, b, t in zip(logs[True], logs[False], told)]


def log_ratio(string: Column, model: list[float]) -> Column:
    """Sum of the model over the neighbouring symbols of a string of ``SYMBOLS``."""
    k = len(SYMBOLS)
    code = {ord(c): i for i, c in enumerate(SYMBOLS)}
    codes, table = F.lit([code.get(i, 0) for i in range(128)]), F.lit([round(x, 9) for x in model])

    def step(a: Column, c: Column) -> Column:
        now = F.get(codes, F.ascii(c))
        more = F.when(a["before"] >= 0, F.get(table, a["before"] * k + now)).otherwise(F.lit(0.0))
        return F.struct(now.alias("before"), (a["sum"] + more).alias("sum"))

    return F.aggregate(F.split(string, ""), F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum")), step, lambda a: a["sum"])


def looks_random(string: Column, model: list[float], min_ratio: float = MIN_RATIO, min_share: float = MIN_SHARE, min_rate: float = MIN_RATE) -> Column:
    """Whether a string of ``SYMBOLS`` passes the ratio, and segments with letters that do by themselves hold enough of its symbols.

    Long compounds of rare words pass the ratio by their length, so it must also be ``min_rate`` a pair of letters and digits. Capitals
    with digits are spared that: they are no compounds of words, and tell less a pair.
    """
    segments = F.filter(F.split(string, "[/._=-]+"), lambda x: x != "")
    random = F.filter(segments, lambda x: x.rlike("[A-Za-z]") & (log_ratio(x, model) > 0))
    symbols = lambda parts: F.length(F.array_join(parts, ""))
    pairs = symbols(segments) - F.size(segments)
    capitals = ~string.rlike("[a-z]") & string.rlike("[0-9]")
    ratio = log_ratio(string, model)
    return (ratio >= min_ratio) & (capitals | (ratio >= F.when(string.rlike("[0-9]"), min_rate).otherwise(min_rate + WORDY) * pairs)) & (symbols(random) >= F.lit(min_share) * symbols(segments))


def find_secrets(docs: DataFrame, model: list[float], min_chars: int = MIN_CHARS, min_ratio: float = MIN_RATIO, text_col: str = "text") -> DataFrame:
    """``docs`` with base_spans and spans, arrays of (start, kind, end) by start and kind; kind indexes ``KINDS``.

    Base spans are all kept. Runs are cut at the borders of base spans; each stretch outside of them that has
    ``min_chars`` symbols or more is scored by itself. Where a stretch isn't random as a whole, those of its segments
    between slashes are scored that are as long, so that a key inside a path is found and the path around it stays.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Columns of their own, each used more than once, so that none is computed again inside another.
    found = docs.withColumn("base_spans", base_spans(text)).withColumn("__open", blanked(text, F.col("base_spans")))
    long = lambda x: F.length(x) >= min_chars
    random = lambda x: long(x) & looks_random(x, model, min_ratio)

    def inside(s: Column) -> Column:
        """Random segments of a run that isn't random as a whole."""
        parts = F.split(s["hit"], "/")
        before = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x) + 1)
        places = F.transform(parts, lambda x, i: F.struct(F.when(long(x), s["start"] + before(i)).alias("start"), F.lit(3).alias("kind"), x.alias("hit")))
        return F.transform(F.filter(places, lambda p: random(p["hit"])), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), (p["start"] + F.length(p["hit"])).alias("end"), p["hit"].alias("hit")))

    runs = _spans(F.col("__open"), RUN % min_chars, 3)
    # Most runs hold no slash: they are judged once.
    good = F.flatten(F.transform(runs, lambda s: F.when(random(s["hit"]), F.array(s)).when(s["hit"].contains("/"), inside(s)).otherwise(F.slice(F.array(s), F.lit(1), F.lit(0)))))
    return found.withColumn("spans", F.array_sort(F.concat("base_spans", _places(good)))).drop("__open")


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch covered by sorted ``spans`` replaced by ``mark``."""
    return _replaced(text, spans, lambda piece, fresh: F.when(fresh, F.lit(mark)).otherwise(F.lit("")))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    return fit_markov(labelled_samples(docs, id_col=id_col, text_col=text_col))
