"""Operator 8: secret scans by dictionary-primed zstandard novelty.

Base kinds are fixed patterns.  Candidates are all strings in a sensitive context:
the values of the base spans, and every long token near a sensitive word, after it on
its line, or on the lines that directly follow.  For each candidate the marginal
compressed bytes are measured: zstandard, primed with a dictionary of the corpus'
identifiers, compresses the surrounding code, all candidates and base spans blanked,
with and without the candidate.  A candidate of ``n`` bytes that adds at least
``NOVEL`` x n bytes is incompressible: a token is reported as ``novel``, a base span
counts in ``n_base_novel``.  Names and prose, which the dictionary or the surroundings
hold already, add little.  Base spans stay whatever their novelty.

The dictionary is made of the identifiers that stand in most documents.  Spark counts
them over all texts, candidates and base spans blanked there too, so that copies of a
secret never vouch for it; it is cut to ``DICT_BYTES``, its size bound.  Rarer words vouch
for themselves: a token that also stands in ``VOUCH`` different surroundings without a
sensitive word is ordinary (copies of a document count once).  Numbers alone are left to the detection of personal data.

Defined results: null text is empty; spans are code points, end exclusive;
repeated rows each get a row; ties between identifiers go to the smaller word; texts
are read whole and the work is linear in their length; other columns of any name are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from statistics import median_low

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import keep, map_rows, prepare, scratch, table

#: The base kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Words of a sensitive context, alone, as parts of snake_case or as the end of camelCase.
_WORDS = ("password", "passwd", "secret", "token", "api_?key", "credential", "bearer", "private", "auth", "authorization", "key")
SENSITIVE = re.compile(rf"(?:(?<![A-Za-z])(?i:{'|'.join(_WORDS)})|(?<=[a-z0-9])(?:{'|'.join(w.capitalize() for w in _WORDS)}))(?i:s?)(?![a-z])")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,39}(?![A-Za-z0-9_])")
AROUND = 200
NEAR = 40
NOVEL = 0.8
DICT_BYTES = 16 << 10
LEVEL = 9
STRETCH, STRETCHES = 1500, 5
#: Different surroundings without a sensitive word (``BESIDE`` characters to either side) from which on a token is ordinary.
VOUCH, BESIDE = 3, 24
#: Different identifiers and tokens that a task counts before it passes them on.
COUNTED = 200_000


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base kinds by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def in_context(text: str):
    """(start, end) of what a sensitive word governs: from the word on the rest of its line, and the directly following lines of its block.

    A blank line ends a block, except between BEGIN and END marks.
    """
    at, on, framed = 0, False, False
    for line in text.split("\n"):
        framed = framed or "-----BEGIN" in line
        if not line.strip():
            on = on and framed
        elif on:
            yield at, at + len(line)
        elif m := SENSITIVE.search(line):
            on = True
            yield at + m.start(), at + len(line)
        framed = framed and "-----END" not in line
        at += len(line) + 1


def candidates(text: str) -> tuple[list[tuple[int, int, int, str]], str, list[tuple[int, int, str]]]:
    """(start, kind, end, string) of the base spans and of the long tokens in a sensitive context beside them, the text with all of these (and every copy of such a token) blanked, and the long tokens in no such context."""
    found = base_spans(text)
    long = [(*m.span(), m[0]) for m in TOKEN.finditer(text)]
    if not long:
        return found, text, []
    lines, base, more, free, k, n, reach = list(in_context(text)), found, [], [], 0, 0, 0
    for a, b, token in long:
        while n < len(base) and base[n][0] < b:
            reach = max(reach, base[n][2])
            n += 1
        if a < reach:
            continue
        while k < len(lines) and lines[k][1] <= a:
            k += 1
        if (k < len(lines) and lines[k][0] < b) or SENSITIVE.search(text, max(0, a - NEAR), min(len(text), b + NEAR)):
            more.append((a, 3, b, token))
        else:
            free.append((a, b, token))
    tokens = {token for *_, token in more}
    blank, at = [], 0
    for a, b in sorted([(a, b) for a, b, token in long if token in tokens] + [(a, b) for a, _, b, _ in base]):
        blank += [text[at:a], " " * (b - max(a, at))]
        at = max(at, b)
    return sorted(base + more), "".join([*blank, text[at:]]), free


def scanned(docs: DataFrame) -> DataFrame:
    """The one scan of the texts, as rows of three sorts.

    ``doc``: doc_id and ``found``, its candidates with what surrounds them.  ``word``: an
    identifier outside of candidates (``w``) and in how many documents it stands (``n``).
    ``token``: a long token and the smallest hashes of its surroundings where these are not
    sensitive.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"sort string, doc_id {kind}, found array<struct<a:bigint,k:bigint,b:bigint,value:string,around:string>>, w string, n bigint, hashes array<bigint>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def scan(batches):
        import pyarrow as pa

        words, tokens = Counter(), {}
        rows = lambda sort, columns: pa.RecordBatch.from_pydict({f.name: [sort] * len(columns[0][1]) if f.name == "sort" else dict(columns).get(f.name, [None] * len(columns[0][1])) for f in arrow}, schema=arrow)

        def counted():
            yield rows("word", [("w", list(words)), ("n", list(words.values()))])
            yield rows("token", [("w", list(tokens)), ("hashes", [sorted(h) for h in tokens.values()])])
            words.clear()
            tokens.clear()

        for batch in batches:
            ids, found = batch.column(0).to_pylist(), []
            for text in batch.column(1).to_pylist():
                spans, blank, free = candidates(text or "")
                found.append([{"a": a, "k": k, "b": b, "value": v, "around": blank[max(0, a - AROUND) : a] + " " + blank[b : b + AROUND]} for a, k, b, v in spans])
                words.update(set(IDENTIFIER.findall(blank)))
                for a, b, token in free:
                    h = tokens.setdefault(token, set())
                    h.add(xxhash.xxh3_64_intdigest(f"{text[max(0, a - BESIDE) : a]} {text[b : b + BESIDE]}".encode("utf-8", "surrogatepass")) >> 1)
                    if len(h) > VOUCH:
                        h.remove(max(h))
                if len(words) + len(tokens) > COUNTED:
                    yield from counted()
            for at in range(0, len(ids), 64):
                yield rows("doc", [("doc_id", ids[at : at + 64]), ("found", found[at : at + 64])])
        yield from counted()

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def identifiers(scan: DataFrame, most: int = DICT_BYTES) -> list[str]:
    """The identifiers that stand in most documents outside of candidates, most frequent first; together at most ``most`` bytes.

    A histogram of the counts (in steps of a sixteenth at most) gives the count that
    enough words reach; only words from there on are sorted, so what the driver gets does not
    grow with the number of partitions.
    """
    words = keep(scan.filter("sort = 'word'").groupBy("w").agg(F.sum("n").alias("n")))
    step = F.expr("n - n % shiftleft(1L, greatest(0, length(bin(n)) - 5))")
    enough, least = most // 4, 0
    for r in words.groupBy(step.alias("n")).agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        least = r.n
        enough -= r.words
        if enough <= 0:
            break
    out, size = [], 0
    for r in words.filter(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(most // 4).collect():
        size += len(r.w) + 1
        if size > most:
            break
        out.append(r.w)
    return out


def ordinary(scan: DataFrame) -> DataFrame:
    """The long tokens that stand in at least ``VOUCH`` different surroundings without a sensitive word: words and names, not secrets."""
    seen = scan.filter("sort = 'token'").select("w", F.explode("hashes").alias("h")).groupBy("w", "h").agg(F.lit(1).alias("one"))
    return seen.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= VOUCH).select("w")


def novelty(words: list[str]):
    """(surroundings, string) -> the bytes that the string adds to the compressed surroundings.

    Short blocks are coded in steps of several bytes, so the surroundings stand behind a
    stretch of the dictionary's words, and the median over ``STRETCHES`` such stretches
    counts.
    """
    import zstandard

    primer = " ".join(reversed(words)).encode()  # zstandard reaches the end of a dictionary most cheaply
    before = [" ".join(words[k::STRETCHES])[:STRETCH] for k in range(STRETCHES)]
    prime = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primer) >= 8 else None
    if prime:
        prime.precompute_compress(level=LEVEL)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=prime, write_content_size=False, write_checksum=False)
    size = lambda x: len(press.compress(x.encode("utf-8", "surrogatepass")))
    return lambda around, value: median_low(size(f"{b} {around} {value}") - size(f"{b} {around} ") for b in before)


def scan_documents(docs: DataFrame) -> DataFrame:
    """A row per document: the base kinds' counts and digest, all spans, and how many tokens and how many base spans are novel."""
    prepare(docs.sparkSession)
    scan = keep(scanned(docs))
    with scratch():
        words = identifiers(scan)
    found = scan.filter("sort = 'doc'").select(F.monotonically_increasing_id().alias("row"), "doc_id", "found")
    said = found.select("row", "doc_id", F.explode("found").alias("x")).select("row", "x.*").withColumn("digits", ~F.rlike("value", F.lit("[^0-9]")))
    known = ordinary(scan)
    said = said.join(known, said.value == known.w, "left").select("row", "a", "k", "b", "value", "around", (F.col("digits") | F.col("w").isNotNull()).alias("plain"))

    def make():
        marginal = novelty(words)
        return lambda row, a, k, b, value, around, plain: [(row, a, k, b, (k < 3 or not plain) and marginal(around, value) >= NOVEL * len(value))]

    said = map_rows(said, make, "row bigint, a bigint, k bigint, b bigint, novel boolean")
    spans = said.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "k", "b", "novel"))).alias("spans"))
    x = keep(found.select("row", "doc_id")).join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<a:bigint,k:bigint,b:bigint,novel:boolean>>")))
    name = lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), (s.k + 1).cast("int")), s.a, s.b)
    is_kind = lambda i: lambda s: s.k == i
    of = lambda cond: F.filter("spans", cond)
    n = lambda cond, c: F.size(of(cond)).cast("bigint").alias(c)
    text = lambda cond: F.array_join(F.transform(of(cond), name), ",")
    return x.select(
        "doc_id", *[n(is_kind(i), f"n_{KINDS[i]}") for i in range(3)], F.sha2(text(lambda s: s.k < 3), 256).alias("base_sha256"),
        text(lambda s: (s.k < 3) | s.novel).alias("spans"), n(lambda s: (s.k == 3) & s.novel, "n_novel"), n(lambda s: (s.k < 3) & s.novel, "n_base_novel"),
    )


def query(spark, sf_dir) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
