"""Operator 3: line dedup by a suffix array over line-ID sequences.

Every document is the sequence of its lines that hold a word; a line's ID is the
hash of its trimmed text.  The suffixes of all sequences are sorted by distributed
prefix doubling.  A suffix's key begins with its first line's ID; round k appends the
rank of its first 2^(k+1) lines among those that share its first 2^k, taken from the
keys of the two halves.  Suffixes whose first 2^k lines occur nowhere else are final
and take part no more; the rounds end when no suffix is repeated, whatever the length
of the repeated runs.

The keys' order is the suffix array.  The longest common prefix of two neighbours
follows from their keys (which agree up to some power of two) and then from the keys
that far into either suffix, until they differ.  The longer one of a suffix's two
is the length of the longest repeated run that starts there; it is maximal if the run
from the line before does not reach as far.

A run counts from ``min_words`` words on.  All of a repeated run is covered by its
shortest parts of ``min_words`` words that begin or end at each of its lines.  Such a
part of m lines belongs to the interval of the suffix array with a common prefix of m
lines, named by two overlapping ranks of 2^k <= m lines.  Each interval keeps its
first place (by ``doc_id``, null first); the lines of all later ones are deleted, except
where one overlaps the kept place: of ``"a b"`` forty times, four lines (8 words) stay.

Hot lines cost no more than others: ranks come from range-partitioned sorts,
intervals from aggregates with partial sums, and both return by joins that Spark
can split.

Defined results: null text stays null and has no lines; lines without a word are
never deleted and do not part a run; rows that agree in doc_id and text are one
document, so each gets the same result; ties between equal suffixes go by doc_id; a
document may lose all of its lines (empty text); texts are read whole, a very long one is as many
rows as it has lines; extra columns of any name pass through ``dedup``; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import lookup
from .common import BROADCAST_ROWS, doc_hash, forget, keep, prepare, scratch, table

MIN_WORDS = 8
_TRIM = "\x20\x09\x0a\x0b\x0c\x0d"
_SPACE = r"[\x20\x09-\x0D]+"
_CHAR = r"[^\x20\x09-\x0D]"
_DOC = ("doc_id", "_h")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    """``line`` without white space at its ends; most lines have none, and trimming a set of characters allocates twice a line's size."""
    return F.when((F.ascii(line) > 32) & (F.ascii(F.right(line, F.lit(1))) > 32), line).otherwise(F.trim(line, F.lit(_TRIM)))


def _words(line: Column, limit: int) -> Column:
    """Words of a trimmed ``line``, counted to ``limit``: most lines have as many, which a match says without parting the line."""
    enough = F.rlike(line, F.lit(f"^(?:{_CHAR}++{_SPACE}+){{{limit - 1}}}{_CHAR}"))
    return F.when(enough, limit).otherwise(F.size(F.split(line, _SPACE, limit)))


def _place(at: str = "pos") -> Column:
    return F.struct(*_DOC, F.col(at).alias("pos"))


#: Bytes of a key: the first line's ID, and each rank that follows.
_ID, _RANK = 16, 8


def _prefix(key: Column, level: Column | int) -> Column:
    """The part of a key that names the first 2^level lines."""
    return F.substring(key, F.lit(1), F.lit(_ID) + F.lit(_RANK) * level)


def _lines_of(docs: DataFrame, min_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """_DOC, pos, ln, nw, key, full (rounds in which both halves were whole), open: the lines that occur more than once, each once per document; and the tables that they are read from."""
    seq = F.filter(F.transform(_lines(F.col("text")), lambda l, i: F.struct(i.alias("ln"), _trimmed(l).alias("line"))), lambda s: s.line != "")
    base = docs.select("doc_id", doc_hash().alias("_h"), F.posexplode(seq).alias("pos", "s"))
    base = base.select(*_DOC, "pos", F.col("s.ln").alias("ln"), F.unhex(F.md5("s.line")).alias("key"), _words(F.col("s.line"), min_words).alias("nw"))
    base = keep(base)  # texts are read and hashed once
    # at more than one place: not all parts of the place are constant.  Numbers are compared by hash, structs only by sorting
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in (*_DOC, "pos") for f in (F.min, F.max)]
    same = F.col("known").isin(0, F.col("n")) & F.col("doc_id_min").eqNullSafe(F.col("doc_id_max")) & (F.col("_h_min") == F.col("_h_max")) & (F.col("pos_min") == F.col("pos_max"))
    again = keep(base.groupBy("key").agg(F.count("*").alias("n"), F.count("doc_id").alias("known"), *ends).filter(~same).select("key"))
    # rows of one document that agree in pos are the same: they meet where the first round looks ahead, so no exchange or sort is spent on them
    x = base.join(lookup(again, BROADCAST_ROWS), "key").withColumn("_same", F.lag("pos").over(Window.partitionBy(*_DOC).orderBy("pos")).eqNullSafe(F.col("pos"))).filter("NOT _same")
    return x.select(*_DOC, "pos", "ln", "nw", "key", F.lit(0).alias("full"), F.lit(True).alias("open")), [base, again]


def _on_place(a: DataFrame, b: DataFrame, pos: str = "pos") -> Column:
    return a.doc_id.eqNullSafe(b._d) & (a._h == b._k) & (a[pos] == b._at)


def sort_suffixes(x: DataFrame, read: list[DataFrame]) -> tuple[DataFrame, int]:
    """``x`` (read from the kept tables ``read``) with the final keys, and the number of rounds: prefix doubling until no suffix is repeated.

    A suffix looks ahead within its document, so documents without a repeated suffix are set
    aside: a round's work follows the documents that it still concerns.
    """
    by_doc = Window.partitionBy(*_DOC).orderBy("pos")
    k, aside = 0, []
    while True:
        ahead = F.last(F.struct("key", "full")).over(by_doc.rangeBetween(2**k, 2**k))
        live = F.max("open").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        names = x.columns
        x = keep(x.withColumns({"ahead": ahead, "live": live}).select(*names, F.col("ahead.key").alias("next"), (F.col("ahead.full") == k).alias("whole"), "live"))
        forget(*read)
        read = [x]
        if k:
            aside.append(x.filter("NOT live").select(*names))
        going = F.col("open") & F.col("next").isNotNull()
        pairs = x.filter(going)
        # a second half that ends or becomes unique sooner still counts for the order
        ranks = pairs.groupBy("key", "next").agg(F.max("whole").alias("whole"), (F.max("whole") & (F.count("*") > 1)).alias("again"))
        ranks = keep(ranks.orderBy("key", "next").select("key", "next", "whole", "again", F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 2 * _RANK, "0")).alias("rank")))
        rest = x.filter(F.col("live") & ~going).select(*_DOC, "pos", "ln", "nw", "key", "full", F.lit(False).alias("open"))
        if ranks.isEmpty():
            break
        longer = pairs.drop("whole", "live").join(ranks, ["key", "next"]).select(*_DOC, "pos", "ln", "nw", F.concat("key", "rank").alias("key"), (F.col("full") + F.col("whole").cast("int")).alias("full"), F.col("again").alias("open"))
        old, rest = x, keep(longer.unionByName(rest))
        x = rest
        forget(ranks, *([] if k else [old]))  # a round's table is kept for the documents set aside in it
        k, read = k + 1, [x]
        if x.filter("open").isEmpty():
            break
    for part in aside:
        rest = rest.unionByName(part)
    return keep(rest), k


def _agree(a: str, b: str, rounds: int) -> Column:
    """How many lines the keys of two structs show to be equal: the largest power of two whose ranks agree, or 0."""
    n = F.lit(0)
    for k in range(rounds + 1):
        size = _ID + _RANK * k
        n = F.when((F.col(f"{a}.full") >= k) & (F.substring(f"{a}.key", 1, size) == F.substring(f"{b}.key", 1, size)), 2**k).otherwise(n)
    return n


def longest_repeats(x: DataFrame, rounds: int) -> DataFrame:
    """_DOC, pos, reach: the lines of the longest repeated run that starts at each suffix, from the neighbours in the suffix array."""
    me = F.struct(*_DOC, "pos", "key", "full")
    order = keep(x.select(me.alias("p")).repartitionByRange("p.key", "p.doc_id", "p._h", "p.pos").sortWithinPartitions("p.key", "p.doc_id", "p._h", "p.pos").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "p"))
    # the last suffix of each partition precedes the first of the next: as many rows as partitions
    edge = order.groupBy("part").agg(F.max_by("p", "at").alias("p")).select(F.lead("part").over(Window.orderBy("part")).alias("_part"), F.col("p").alias("_last"))
    in_part = Window.partitionBy("part").orderBy("at")
    q = order.select("part", "p", F.lag("p").over(in_part).alias("q")).join(F.broadcast(edge), F.col("part") == F.col("_part"), "left")
    q = q.select("p", F.coalesce("q", "_last").alias("q")).filter("q IS NOT NULL").withColumn("m", _agree("p", "q", rounds)).filter("m > 0")
    side = lambda c: F.struct(F.col(f"{c}.doc_id").alias("doc_id"), F.col(f"{c}._h").alias("_h"), F.col(f"{c}.pos").alias("pos"))
    todo = keep(q.select(side("p").alias("p"), side("q").alias("q"), "m"))
    done = [todo]
    while True:
        look = todo
        for c in ("p", "q"):
            keys = x.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k"), F.col("pos").alias("_at"), F.struct("key", "full").alias(f"{c}_key"))
            on = F.col(f"{c}.doc_id").eqNullSafe(F.col("_d")) & (F.col(f"{c}._h") == F.col("_k")) & (F.col(f"{c}.pos") + F.col("m") == F.col("_at"))
            look = look.join(keys, on).drop("_d", "_k", "_at")
        todo = keep(look.withColumn("more", _agree("p_key", "q_key", rounds)).filter("more > 0").select("p", "q", (F.col("m") + F.col("more")).alias("m")))
        if todo.isEmpty():
            break
        done.append(todo)
    both = None
    for d in done:
        for c in ("p", "q"):
            part = d.select(f"{c}.*", "m")
            both = part if both is None else both.unionByName(part)
    return both.groupBy(*_DOC, "pos").agg(F.max("m").alias("reach"))


def _whole_parts(x: DataFrame, rounds: int, min_words: int) -> DataFrame:
    """_DOC, pos, m, ra, rb, lns: the shortest parts of ``min_words`` words that begin, or end, at each line, where they are repeated."""
    by_doc = Window.partitionBy(*_DOC).orderBy("pos")
    top = min(rounds, min_words.bit_length() - 1)  # a part has at most min_words lines
    cell = F.struct("pos", "ln", "nw", "reach", _prefix(F.col("key"), top).alias("key"))
    ahead = F.collect_list(cell).over(by_doc.rangeBetween(0, min_words - 1))
    behind = F.collect_list(cell).over(by_doc.rangeBetween(1 - min_words, 0))
    fold = lambda sign: (
        f"aggregate(run, named_struct('w', 0, 'm', 0), (a, c) -> CASE WHEN a.w < {min_words} AND c.pos = pos {sign} a.m THEN named_struct('w', a.w + c.nw, 'm', a.m + 1) ELSE a END)"
    )
    parts = None
    for run, sign in ((ahead, "+"), (F.reverse(behind), "-")):
        y = x.select(*_DOC, "pos", run.alias("run")).withColumn("f", F.expr(fold(sign))).filter(f"f.w >= {min_words}")
        y = y.withColumn("run", F.slice("run", 1, F.col("f.m")))
        if sign == "-":
            y = y.withColumn("run", F.reverse("run"))
        parts = y if parts is None else parts.unionByName(y)
    parts = parts.withColumn("m", F.size("run")).filter(F.element_at("run", 1).reach >= F.col("m"))
    k = F.length(F.bin("m")) - 1
    second = F.element_at("run", F.expr("int(m - shiftleft(1, length(bin(m)) - 1) + 1)"))
    return keep(parts.select(*_DOC, F.element_at("run", 1).pos.alias("pos"), "m", _prefix(F.element_at("run", 1).key, k).alias("ra"), _prefix(second.key, k).alias("rb"), F.transform("run", lambda c: c.ln).alias("lns")))


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, _h, lines (numbers of the lines to delete), mask (the same as bytes), n_runs and longest_run (the maximal repeated runs of ``min_words`` words that start in it), for every document that has any."""
    prepare(docs.sparkSession)
    with scratch() as stay:
        return stay(_find_repeats(docs, min_words))


def _find_repeats(docs: DataFrame, min_words: int) -> DataFrame:
    x, rounds = sort_suffixes(*_lines_of(docs, min_words))
    reach = longest_repeats(x, rounds).select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k"), F.col("pos").alias("_at"), "reach")
    x = keep(x.join(reach, _on_place(x, reach), "left").select(*_DOC, "pos", "ln", "nw", "key", F.coalesce("reach", F.lit(0)).alias("reach")))

    parts = _whole_parts(x, rounds, min_words)
    place = _place()
    # stored first, so that the join has an exchange on either side and the parts of a hot line can be split
    spans = keep(parts.groupBy("m", "ra", "rb").agg(F.min(place).alias("at"), F.max(place).alias("to")).filter(~F.col("at").eqNullSafe(F.col("to"))).drop("to"))
    own = F.col("at.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("at._h") == F.col("_h")) & (F.col("pos") < F.col("at.pos") + F.col("m"))
    later = parts.join(spans, ["m", "ra", "rb"]).filter(~own)
    cut = later.select(*_DOC, F.explode("lns").alias("ln")).groupBy(*_DOC).agg(F.sort_array(F.collect_set("ln")).alias("lines"))

    by_doc = Window.partitionBy(*_DOC).orderBy("pos")
    words = F.sum("nw").over(by_doc.rowsBetween(Window.unboundedPreceding, 0))
    runs = x.withColumn("upto", words).withColumn("before", F.last("reach").over(by_doc.rangeBetween(-1, -1)))
    runs = runs.filter("reach > 0 AND (before IS NULL OR before <= reach)")
    ends = x.withColumn("to", words).select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k"), F.col("pos").alias("_at"), "to")
    runs = runs.withColumn("end", F.col("pos") + F.col("reach") - 1)
    runs = runs.join(ends, _on_place(runs, ends, "end"))
    runs = runs.filter(F.col("to") - F.col("upto") + F.col("nw") >= min_words).groupBy(*_DOC).agg(F.count("*").alias("n_runs"), F.max("reach").alias("longest_run"))
    runs = runs.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k"), "n_runs", "longest_run")
    out = cut.join(runs, cut.doc_id.eqNullSafe(runs._d) & (cut._h == runs._k), "full")
    # one byte per line up to the last deleted one, 1 where deleted: looked up in one step, so long documents cost linear work
    byte = F.transform("lines", lambda n, i: F.concat(F.repeat(F.lit("00"), n - F.coalesce(F.when(i > 0, F.get("lines", i - 1)), F.lit(-1)) - 1), F.lit("01")))
    return keep(out.select(F.coalesce("doc_id", "_d").alias("doc_id"), F.coalesce("_h", "_k").alias("_h"), "lines", F.unhex(F.array_join(byte, "")).alias("mask"), "n_runs", "longest_run"))


def _with_cuts(docs: DataFrame, min_words: int) -> tuple[DataFrame, str]:
    """``docs`` under names c0, c1 ... with the text that is left, ``_cut`` (how many lines are deleted), ``_runs`` and ``_longest``; the text's name."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*names)
    ids, texts = names[docs.columns.index("doc_id")], names[docs.columns.index("text")]
    cut = find_repeats(wide.select(F.col(ids).alias("doc_id"), F.col(texts).alias("text")), min_words)
    cut = cut.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k"), F.size("lines").alias("_cut"), F.col("mask").alias("_mask"), F.col("n_runs").alias("_runs"), F.col("longest_run").alias("_longest"))
    x = wide.withColumn("_h", F.xxhash64(F.col(ids), F.col(texts)))
    x = x.join(cut, x[ids].eqNullSafe(cut._d) & (x._h == cut._k), "left").drop("_d", "_h", "_k")
    left = F.array_join(F.filter(_lines(F.col(texts)), lambda l, i: F.substring("_mask", i + 1, F.lit(1)) != F.unhex(F.lit("01"))), "\n")
    x = x.withColumn(texts, F.when(F.col("_mask").isNull(), F.col(texts)).otherwise(left)).drop("_mask")
    return x, texts


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``; a column ``n_chars`` follows."""
    x, texts = _with_cuts(docs, min_words)
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        x = x.withColumn(n, F.when(F.coalesce("_cut", F.lit(0)) <= 0, F.col(n)).otherwise(F.length(texts)).cast(docs.schema["n_chars"].dataType))
    return x.drop("_cut", "_runs", "_longest").toDF(*docs.columns)


def query(spark, sf_dir) -> DataFrame:
    """doc_id, lines, deleted lines, maximal repeated runs and the lines of the longest, and the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).alias("n_lines"))
    x, _ = _with_cuts(docs, MIN_WORDS)
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")
    return x.select(
        F.col("c0").alias("doc_id"), F.greatest("c2", F.lit(0)).cast("long").alias("n_lines"), zero("_cut").alias("n_deleted"),
        zero("_runs").alias("n_runs"), zero("_longest").alias("longest_run"), F.col("c1").alias("text"),
    )


SQL = f"""
WITH l AS (SELECT doc_id, ln, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS nw FROM l WHERE line <> ''),
r AS (SELECT a.doc_id, a.pos AS s, e.pos AS t, string_agg(m.line, chr(10) ORDER BY m.pos) AS run, sum(m.nw) AS w, arg_min(m.nw, m.pos) AS w1, arg_max(m.nw, m.pos) AS w2
  FROM b a JOIN b e ON a.doc_id = e.doc_id AND e.pos BETWEEN a.pos AND a.pos + {MIN_WORDS - 1} JOIN b m ON m.doc_id = a.doc_id AND m.pos BETWEEN a.pos AND e.pos GROUP BY ALL),
q AS (SELECT * FROM r WHERE w >= {MIN_WORDS} AND (w - w1 < {MIN_WORDS} OR w - w2 < {MIN_WORDS})),
o AS (SELECT *, first(doc_id) OVER w AS d0, first(t) OVER w AS t0, row_number() OVER w AS k FROM q WINDOW w AS (PARTITION BY run ORDER BY doc_id, s)),
c AS (SELECT DISTINCT b.doc_id, b.ln FROM o JOIN b ON o.doc_id = b.doc_id AND b.pos BETWEEN s AND t WHERE k > 1 AND (o.doc_id <> d0 OR s > t0)),
eq AS (SELECT a.doc_id, a.pos, a.pos - row_number() OVER (PARTITION BY a.doc_id, e.doc_id, a.pos - e.pos ORDER BY a.pos) AS g, e.doc_id AS other, a.pos - e.pos AS d
  FROM b a JOIN b e ON a.line = e.line AND (a.doc_id <> e.doc_id OR a.pos <> e.pos)),
lcp AS (SELECT doc_id, pos, max(last - pos + 1) AS reach FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id, other, d, g) AS last FROM eq) GROUP BY ALL),
top AS (SELECT x.doc_id, x.pos, x.reach FROM lcp x LEFT JOIN lcp y ON x.doc_id = y.doc_id AND y.pos = x.pos - 1 WHERE y.reach IS NULL OR y.reach <= x.reach),
runs AS (SELECT doc_id, count(*) AS n_runs, max(reach) AS longest_run FROM (
  SELECT top.doc_id, top.pos, reach FROM top JOIN b ON b.doc_id = top.doc_id AND b.pos BETWEEN top.pos AND top.pos + reach - 1 GROUP BY ALL HAVING sum(nw) >= {MIN_WORDS}) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(any_value(n), 0) AS n_deleted,
  coalesce(any_value(runs.n_runs), 0) AS n_runs, coalesce(any_value(runs.longest_run), 0) AS longest_run,
  CASE WHEN any_value(n) IS NULL THEN any_value(d.text) ELSE coalesce(any_value(x.text), '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents) ANTI JOIN c USING (doc_id, ln) GROUP BY doc_id) x USING (doc_id)
LEFT JOIN runs USING (doc_id)
GROUP BY d.doc_id, d.text
"""
