"""Quality rules with cross-document line frequency. DataFrame operations only.

Normalised lines are hashed, the distinct documents that hold a line are counted per host (the column source), lines
above the host's limit are removed, and a document that loses most of its words is rejected with those that fail the
base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SPACE, WORD, materialize, shielded, words
from .mixing import hash60

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A line is above the limit if more than LIMIT_DOCS of its host's documents hold it, and these are more than this share
#: of them or more than LIMIT_MOST.
LIMIT_PERCENT, LIMIT_DOCS, LIMIT_MOST = 2, 10, 5000
#: A document is depleted if it keeps under MIN_WORDS words or under this share of them.
LEFT_PERCENT = 30


def fence(df: DataFrame, **columns: Column) -> DataFrame:
    """df and the columns, each computed once a row. A generator over one element keeps the optimizer from writing
    their expressions into the lambdas that read them, where they would run once an element."""
    return df.select(*df.columns, F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("fence__")).select(*df.columns, "fence__.*")


def _twins(at: Column) -> Column:
    """Positions of the sorted (hash, position) pairs that have a neighbour with the same hash."""
    same = lambda x, i, j: F.coalesce(F.get(at, i + j)["h"] == x["h"], F.lit(False))
    return F.transform(F.filter(at, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])


def _covered(at: Column) -> Column:
    """Words under the windows that start at these sorted positions."""
    return F.aggregate(
        at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, x: F.struct((s["n"] + F.least(F.lit(WINDOW), x - s["last"])).alias("n"), x.alias("last")), lambda s: s["n"],
    )


def line_keys(text: Column) -> Column:
    """Hashes of the normalised lines, one for each \\n-split line, null for a line without a word.

    Normalised: lower case, digit runs as 0, no white space at the ends.
    """
    flat = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[0-9]+", "0"))
    trim = lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r"))
    return F.transform(F.split(flat, "\n", -1), lambda x: F.when(x.rlike(f"[^{SPACE}]"), hash60(trim(x))))


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _set(keys: Column) -> Column:
    """Sorted distinct line hashes, of which the XXH64 tells documents apart."""
    return F.sort_array(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))


def _held(docs: DataFrame) -> DataFrame:
    """(host, set, key), distinct: a line of a document, where documents with the same lines are one."""
    rows = fence(docs.select(_host().alias("host"), "text"), keys=_set(line_keys(F.col("text"))))
    return rows.select("host", F.xxhash64("keys").alias("set"), F.explode("keys").alias("key")).distinct()


def frequent_lines(docs: DataFrame) -> DataFrame:
    """(host, key): the hashes of each host's lines above the limit.

    Documents that hold a line count once for each set of line hashes, told apart by its XXH64, so that copies of one
    document count once however many there are.
    """
    counts = _held(docs).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > LIMIT_DOCS)
    sizes = docs.select(_host().alias("host")).groupBy("host").agg(F.count("*").alias("docs"))
    above = (F.col("n") * 100 > F.col("docs") * LIMIT_PERCENT) | (F.col("n") > LIMIT_MOST)
    return counts.join(sizes, "host").where(above).select("host", "key")


def _with_often(docs: DataFrame) -> DataFrame:
    """docs and often__: hashes of lines above the limit, all of the host's or those of the document; null without any.

    The hosts' lists are broadcast if they fit. Else documents meet the lines they lose by host and set of lines, a key
    that spreads a host with many documents over all tasks, and lists are no longer than a document.
    """
    lines = materialize(frequent_lines(docs))
    n_lines, width = lines.agg(F.count("*"), F.coalesce(F.max(F.length("host")), F.lit(0))).first()
    if n_lines * (4 * width + 48) <= BROADCAST_BYTES:
        some = F.broadcast(lines.groupBy(F.col("host").alias("host__")).agg(F.collect_list("key").alias("often__")))
        return docs.join(some, _host() == F.col("host__"), "left").select(*docs.columns, "often__")
    lost = _held(docs).join(lines, ["host", "key"]).groupBy(F.col("host").alias("host__"), F.col("set").alias("set__")).agg(F.collect_list("key").alias("often__"))
    own = fence(docs, mark__=F.xxhash64(_set(line_keys(F.col("text")))))
    return own.join(lost, (_host() == F.col("host__")) & (F.col("mark__") == F.col("set__")), "left").select(*docs.columns, "often__")


def judge(docs: DataFrame) -> DataFrame:
    """docs with the base figures n_words__, word_chars__, n_symbols__, n_dup_lines__ and n_repeat_words__, cut__ (the
    text without lines above the limit, null where none was removed), base_failed__ and kept__. Needs doc_id, text and
    source; other columns pass through.

    A null text is empty and fails the base rules; null sources are one host. Rows that repeat are judged alike; texts of
    any length are read whole; empty input gives no rows. Columns of docs must not end in two underscores.
    Windows are told apart by XXH64 of their five words, of 64 bits, within one document only.
    """
    text, c = F.coalesce(F.col("text"), F.lit("")), F.col
    whole = _with_often(docs)
    one = fence(whole, words__=words(F.col("text")), lines__=F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")),
                keys__=F.when(c("often__").isNotNull(), line_keys(F.col("text"))))
    w = c("words__")
    starts = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
    two = fence(
        one, n_words__=F.size(w).cast("long"), word_chars__=F.char_length(F.array_join(w, "")).cast("long"), n_symbols__=F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        n_dup_lines__=(F.size("lines__") - F.size(F.array_distinct("lines__"))).cast("long"), windows__=F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
        out__=F.when(F.arrays_overlap("keys__", "often__"), F.array_intersect("keys__", "often__")),
    ).drop("words__", "lines__", "often__")
    h = c("windows__")
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.array_contains(c("out__"), F.get("keys__", i)), F.lit(False)))
    three = fence(two, at__=F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(pairs)), cut__=F.when(c("out__").isNotNull(), F.array_join(left, "\n"))).drop("windows__", "keys__", "out__")
    four = fence(three, twins__=F.when(c("at__").isNotNull(), F.sort_array(_twins(c("at__")))), n_left__=F.when(c("cut__").isNotNull(), F.regexp_count("cut__", F.lit(WORD)))).drop("at__")
    five = fence(four, n_repeat_words__=F.coalesce(F.when(c("twins__").isNotNull(), _covered(c("twins__"))), F.lit(0)).cast("long")).drop("twins__")
    failed = (c("n_words__") < MIN_WORDS) | (100 * c("n_repeat_words__") > MAX_REPEAT_PERCENT * c("n_words__"))
    n_left = F.coalesce("n_left__", "n_words__")
    depleted = (n_left < MIN_WORDS) | (100 * n_left < LEFT_PERCENT * c("n_words__"))
    return five.withColumns({"base_failed__": failed, "kept__": ~failed & ~depleted}).drop("n_left__")


def quality(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of docs."""
    return judge(docs.select("doc_id", "text", "source")).select(
        "doc_id", *[F.col(f"{c}__").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("base_failed__").alias("base_failed"), F.col("kept__").alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, without the lines above the limit; n_chars follows where the text changed.

    Nulls, repeated rows and empty tables as in `judge`; other columns pass through, whatever their names.
    """
    return shielded(docs, ("doc_id", "text", "source", "n_chars"), _keep_good)


def _keep_good(docs: DataFrame) -> DataFrame:
    cut = F.col("cut__")
    put = {"text": F.coalesce(cut, F.col("text"))} | ({"n_chars": F.when(cut.isNull(), F.col("n_chars")).otherwise(F.char_length(cut)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return judge(docs).where("kept__").withColumns(put).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t, coalesce('s' || source, 'n') host FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, string_split(t, chr(10)) l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) i FROM w WHERE len(w) >= 5)),
v AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) n FROM g) WHERE n > 1),
x AS (SELECT r, count(DISTINCT i + k)::BIGINT n FROM v, range(5) t(k) GROUP BY r),
base AS (SELECT w.r, len(w)::BIGINT n_words, len(array_to_string(w, ''))::BIGINT word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT n_symbols,
  (len(list_filter(l, lambda z: regexp_matches(z, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda z: regexp_matches(z, '[^\x20\x09-\x0D]')))))::BIGINT n_dup_lines,
  coalesce(n, 0)::BIGINT n_repeat_words FROM w JOIN d ON w.r = d.r LEFT JOIN x ON w.r = x.r),
ln AS (SELECT r, host, unnest(string_split(t, chr(10))) raw, generate_subscripts(string_split(t, chr(10)), 1) i FROM d),
k AS (SELECT r, host, raw, i, CASE WHEN regexp_matches(raw, '[^\x20\x09-\x0D]') THEN
  ('0x' || substr(md5(trim(lower(regexp_replace(raw, '[0-9]+', '0', 'g')), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 1, 15))::BIGINT END key FROM ln),
u AS (SELECT DISTINCT r, host, key FROM k WHERE key IS NOT NULL),
st AS (SELECT r, md5(string_agg(key::VARCHAR, ',' ORDER BY key)) st FROM u GROUP BY r),
often AS (SELECT u.host, key FROM u JOIN st ON u.r = st.r JOIN (SELECT host, count(*) docs FROM d GROUP BY host) s ON u.host = s.host GROUP BY u.host, key, docs
  HAVING count(DISTINCT st) > 10 AND (count(DISTINCT st) * 100 > docs * 2 OR count(DISTINCT st) > 5000)),
n AS (SELECT r, sum(len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')))::BIGINT n_left FROM k LEFT JOIN often ON k.host = often.host AND k.key = often.key
  WHERE often.key IS NULL GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(n_left, 0) >= 10 AND 100 * coalesce(n_left, 0) >= 30 * n_words kept
FROM base JOIN d ON base.r = d.r LEFT JOIN n ON base.r = n.r
"""
