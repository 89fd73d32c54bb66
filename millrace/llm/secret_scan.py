"""Secret scans, DataFrame functions only.

Base spans are the matches of fixed patterns. Beside them, two character Markov models - of
random strings and of ordinary identifiers, trained from labelled samples - score every token of
token characters by its log-likelihood ratio per step; a token that the random model explains
better by MIN_RATIO, and that touches no base span, is a span of kind ``random``. Steps are those
between letters and digits: separators (/ _ - + =) part names, dates and paths as they part
random strings, and say nothing.

Ordinary samples are the words of all documents, and made ones for what prose has none of: plain
numbers, dates, and words with numbers. Random samples are made from digests of counters.

Positions come from the pieces between matches: lengths of gaps and matches, summed along a
document by a window over its few matches. Spans are found by one scan of the texts and written;
no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

# The base patterns, whole match as group 0, and what a match must have.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
ASSIGN_VALUE = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Tokens that the models judge, and the least mean log-likelihood ratio of a step that makes one a span.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_RATIO = 1.0
#: Steps are between two characters of the alphabet. Ordinary words of documents are runs of letters.
STEP, LETTERS = r"^[A-Za-z0-9]{2}$", r"[A-Za-z]{4,}"
#: Labelled samples: counters whose digests make random strings, and of which ordinary numbers, dates and names are made.
RANDOM_SAMPLES, ORDINARY_SAMPLES = 4000, 4000
# Words that stand with a number in ordinary names.
NAMES = ["page", "version", "v", "file", "item", "python", "test", "part", "chapter", "section", "log", "backup", "user", "order", "build", "node", "id", "lib", "utf", "x"]


def matches(text: Column, kind: int, pattern: str) -> Column:
    """kind, the lengths of the gaps before each match, and the matches; null without any."""
    return F.when(text.rlike(pattern), F.struct(
        F.lit(kind).alias("kind"),
        F.transform(F.split(text, pattern), F.char_length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
    ))


def located(docs: DataFrame) -> DataFrame:
    """id, key, kind, start, end, value of every match of every pattern. docs: id, key, text."""
    patterns = [ASSIGN, ACCESS, HEX, TOKEN]
    found = F.array_compact(F.array(*(matches(F.col("text"), k, p) for k, p in enumerate(patterns))))
    rows = docs.select("id", "key", F.monotonically_increasing_id().alias("row"), F.explode(found).alias("m"))
    rows = rows.select("id", "key", "row", "m.kind", F.posexplode(F.arrays_zip("m.found", F.slice("m.gaps", F.lit(1), F.size("m.found")).alias("gap"))).alias("pos", "one"))
    rows = rows.select("id", "key", "row", "kind", "pos", F.col("one")["found"].alias("value"), F.col("one")["gap"].alias("gap"))
    before = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.char_length("value")).over(before)).withColumn("start", F.col("end") - F.char_length("value"))
    passes = (F.col("kind") != 0) | (F.char_length(F.regexp_extract("value", ASSIGN, 1)) >= ASSIGN_VALUE)
    return rows.filter(passes).select("id", "key", "kind", "start", "end", "value")


def pairs(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each step between two neighbouring characters of the alphabet."""
    steps = F.transform(F.sequence(F.lit(1), F.char_length(text) - 1), lambda i: F.substring(F.col(text), i, F.lit(2)))
    return df.filter(F.char_length(text) >= 2).select(*keep, F.explode(F.filter(steps, lambda p: p.rlike(STEP))).alias("pair"))


def labelled_samples(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """sample, random (1 or 0), n (times it occurs). docs: id, key, text."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    plain64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    made = spark.range(RANDOM_SAMPLES).select(F.explode(F.array(digest, plain64, F.translate(F.upper(plain64), "+/", "23"))).alias("sample"))
    day = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 5).cast("int")).cast("string")
    number = F.pmod(F.col("id") * 2654435761, F.lit(10**12)).cast("string")
    name = F.concat(F.element_at(F.array(*map(F.lit, NAMES)), (F.col("id") % len(NAMES) + 1).cast("int")), (F.col("id") % 997).cast("string"))
    ordinary = spark.range(ORDINARY_SAMPLES).select(F.explode(F.array(day, F.regexp_replace(day, "-", ""), number, name)).alias("sample"))
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("sample")).unionByName(ordinary)
    # Counted by word first, so that each distinct word is cut into pairs once.
    return made.withColumn("random", F.lit(1)).unionByName(words.withColumn("random", F.lit(0))).groupBy("sample", "random").agg(F.count(F.lit(1)).alias("n"))


def train(samples: DataFrame) -> DataFrame:
    """pair, ratio: ln P(random) - ln P(ordinary) of the step. len(ALPHABET)^2 rows.

    Steps are smoothed by the second character's own share (with one added count), so a step from
    or to a character that ordinary text hardly has speaks for a random string.
    """
    spark = samples.sparkSession
    counts = pairs(samples, "sample", "random", "n").groupBy("pair").agg(
        F.sum(F.col("random") * F.col("n")).alias("n1"), F.sum((1 - F.col("random")) * F.col("n")).alias("n0"))
    letters = F.array(*map(F.lit, ALPHABET))
    every = spark.range(1).select(F.explode(letters).alias("a")).select("a", F.explode(letters).alias("b")).withColumn("pair", F.concat("a", "b"))
    both = every.join(counts, "pair", "left").na.fill(0, ["n1", "n0"])
    first, second, whole = Window.partitionBy("a"), Window.partitionBy("b"), Window.partitionBy(F.lit(0))
    size = float(len(ALPHABET))

    def log_p(n: str) -> Column:
        unigram = (F.sum(n).over(second) + 1.0) / (F.sum(n).over(whole) + size)
        return F.log((F.col(n) + F.lit(size) * unigram) / (F.sum(n).over(first) + size))

    return both.select("pair", (log_p("n1") - log_p("n0")).alias("ratio"))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (hash of the text), kind (index in KINDS), start, end, value of each span of each distinct (id, text).

    Null text counts as empty and has none. Offsets are code points, end exclusive. Rows
    repeated with one id and text share their spans. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    spans = saved(located(docs).distinct(), "spans")
    token, base = spans.filter("kind = 3"), spans.filter("kind < 3")
    model = train(labelled_samples(docs, df.sparkSession))
    steps = pairs(token, "value", "id", "key", "start", "end", "value")
    # The model has len(ALPHABET)^2 rows whatever the input, so it is broadcast.
    judged = steps.join(F.broadcast(model), "pair").groupBy("id", "key", "start", "end", "value").agg(F.avg("ratio").alias("ratio"))
    added = judged.filter(F.col("ratio") >= MIN_RATIO).select("id", "key", F.lit(3).alias("kind"), "start", "end", "value")
    every = base.unionByName(added)
    # Over one document's spans by start: how far base spans reach before, and where the next one begins.
    by_doc = Window.partitionBy("id", "key").orderBy("start", "kind")
    reach = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(by_doc.rowsBetween(1, Window.unboundedFollowing))
    marked = every.withColumn("reach", reach).withColumn("ahead", ahead)
    touches = (F.col("kind") == 3) & ((F.coalesce("reach", F.lit(0)) > F.col("start")) | (F.coalesce("ahead", F.col("end")) < F.col("end")))
    return marked.filter(~touches).drop("reach", "ahead")


def gathered(spans: DataFrame) -> DataFrame:
    """One row per (id, key): its spans by start, then kind, with the furthest end before each."""
    before = Window.partitionBy("id", "key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
    return rows.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "done"))).alias("spans"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, spans (array of start, kind, end, done), empty without any.

    Null text counts as empty and has no span; a null id keeps its row and its spans. Rows
    repeated with one id and text have the same spans. Other columns are not read, so their names
    cannot clash. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__key"))
    found = gathered(secret_spans(df, id_col, text_col))
    joined = rows.join(found, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__key") == F.col("key")), "left")
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,done:bigint>>")
    return joined.select(F.col("__id").alias(id_col), F.coalesce(F.col("spans"), empty).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its text replaced by mark (touching or overlapping spans by one).

    Null text stays null; rows without a span, repeated rows and all other columns, whatever their
    names, stay as they are. An empty table gives an empty result.
    """
    source = F.coalesce(F.col(text_col), F.lit(""))
    found = gathered(secret_spans(df, id_col, text_col)).toDF("span_id", "span_key", "spans")
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(source).alias("key"), F.col(text_col).alias("text"))
    joined = rows.join(found.hint("merge"), F.col("id").eqNullSafe(F.col("span_id")) & (F.col("key") == F.col("span_key")), "left")

    def piece(s: Column) -> Column:
        """What stands between the spans before and this one, and the mark; nothing for a span that goes on from one before."""
        new = (s["start"] > s["done"]) | (s["start"] == 0)
        return F.when(new, F.concat(F.substring(F.col("text"), (s["done"] + 1).cast("int"), (s["start"] - s["done"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))

    rest = F.substring(F.col("text"), (F.array_max(F.transform("spans", lambda s: s["end"])) + 1).cast("int"), F.char_length("text"))
    clean = F.concat(F.array_join(F.transform("spans", piece), ""), rest)
    new = F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean)
    return joined.select(*((new if c == text_col else F.col("row")[c]).alias(c) for c in df.columns))


def span_text(spans: Column, base_only: bool) -> Column:
    """kind:start:end, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"] < 3) if base_only else spans
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
