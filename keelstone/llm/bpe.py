"""Operator 11: byte-pair encoding by an index of pair occurrences, and decoding.

A task takes its texts in blocks.  The distinct words of a block that it does not
remember are laid out as one chain of symbols, and every pair of neighbours is mapped
to all the places where it stands (`PairIndex`).  The ranks that occur are applied in
ascending order: all places of the pair are merged from left to right, and the lists
of the pairs to both sides are updated.  Words do not touch each other, so this gives
each word what encoding it alone gives, and a word of n characters takes about n log n
steps however long it is.

The tokenizer is a public file whose path is a parameter.  The driver reads it and ships
its text to the tasks; its size is that of the file, whatever the corpus.  Special tokens
are cut out of the raw text first, each piece is then normalized and split into words on
its own.  For pieces of characters below U+0300, which are their own normal form, two
regular expressions do this; for others the file's normalizer and splitting rule do.

Defined results: null text counts as empty and has no tokens; special tokens in a text
are tokens; repeated rows each get a row; texts are read whole, whatever their length;
columns besides ``doc_id`` and ``text`` are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame

from .common import prepare, table

VOCABULARY = "word_bpe_49k.json"
#: Characters of the texts that are encoded together, and distinct words whose ids a task remembers before it starts anew.
BLOCK_CHARS = 1 << 20
REMEMBER = 400_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100."""
    prints = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    free = iter(range(256, 512))
    return {b: chr(b if b in prints else next(free)) for b in range(256)}


class PairIndex:
    """Encodes words together: ``merges[r]`` is (left, right, joined), and ``rank`` finds r by left * base + right."""

    def __init__(self, merges: list[tuple[int, int, int]], base: int):
        self.merges, self.base = merges, base
        self.rank = {a * base + b: r for r, (a, b, _) in enumerate(merges)}

    def encode(self, words: list[list[int]]) -> list[list[int]]:
        """The ids of every word, given as initial symbols."""
        rank, merges, base = self.rank.get, self.merges, self.base
        sym = list(chain.from_iterable(words))
        before, after = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
        places: dict[int, list[int]] = defaultdict(list)
        at = 0
        for w in words:
            if w:
                end = at + len(w)
                before[at] = after[end - 1] = -1
                for i in range(at, end - 1):
                    if (r := rank(sym[i] * base + sym[i + 1])) is not None:
                        places[r].append(i)
                at = end
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            left, right, joined = merges[r]
            todo = places.pop(r)
            if left == right:
                todo.sort()  # runs of one symbol merge from the left
            for k, i in enumerate(todo):
                if sym[i] != left or (j := after[i]) < 0 or sym[j] != right:
                    continue  # another merge has taken one of the two
                sym[i], sym[j] = joined, -1
                p, n = before[i], after[j]
                after[i] = n
                if n >= 0:
                    before[n] = i
                    if (q := rank(joined * base + sym[n])) is not None:
                        if q not in places:
                            heapq.heappush(active, q)
                        places[q].append(i)
                if p >= 0 and (q := rank(sym[p] * base + joined)) is not None:
                    if q not in places:
                        heapq.heappush(active, q)
                    places[q].append(p)
                if active and active[0] < r:  # a pair that just arose goes first; the other places wait
                    if rest := todo[k + 1 :]:
                        places[r] = rest + places.get(r, [])
                        heapq.heappush(active, r)
                    break
        out, at = [], 0
        for w in words:
            out.append([s for s in sym[at : at + len(w)] if s >= 0])
            at += len(w)
        return out


class WordBPE:
    """Encoder and decoder of a tokenizer file: BPE over byte letters with a mark at word ends."""

    def __init__(self, text: str):
        import regex

        file = json.loads(text)
        model = file["model"]
        rules = file["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in (*file["normalizer"]["normalizers"], *rules)]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or any(model.get(k) for k in ("unk_token", "byte_fallback", "dropout", "ignore_merges")) or file.get("decoder") or file.get("post_processor"):
            raise ValueError("not a tokenizer of lower-case words over bytes")
        ids, mark, letters = model["vocab"], model["end_of_word_suffix"] or "", byte_letters()
        self.inner = [ids[letters[b]] for b in range(256)]
        self.last = [ids[letters[b] + mark] for b in range(256)]
        special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.tokens: list[str] = [""] * (max(max(ids.values()), *special.values()) + 1)
        for t, i in (*ids.items(), *special.items()):
            self.tokens[i] = t
        self.index = PairIndex([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]], len(self.tokens))
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.rule = rules[0]["pattern"]["Regex"]
        self.words_of, self.plain = regex.compile(self.rule).findall, re.compile(r"[^\x00-\u02FF]")
        self.text, self.library = text, None
        self.known: dict[str, list[int]] = {}

    def words(self, piece: str) -> list[str]:
        """Words of a piece without special tokens."""
        if not self.plain.search(piece):
            return self.words_of(piece.lower())  # words hold no white space, however it is normalized
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self.library = Tokenizer.from_str(self.text).normalizer, pre_tokenizers.Split(Regex(self.rule), "removed", invert=True)
        normal, split = self.library
        return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(piece))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text; the words that are new are encoded together."""
        parts = []
        for t in texts:
            pieces = self.cut.split(t) if self.cut else [t]
            parts.append([self.words(p) if k % 2 == 0 else p for k, p in enumerate(pieces)])
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        new: set[str] = set()
        for row in parts:
            for p in row:
                if type(p) is list:
                    new.update(p)
        long, ordered, symbols = {}, sorted(new.difference(known)), []
        for w in ordered:
            b = w.encode()
            symbols.append([*map(self.inner.__getitem__, b[:-1]), self.last[b[-1]]])
        for w, ids in zip(ordered, self.index.encode(symbols)):
            (known if len(w) <= 64 else long)[w] = ids
        find = known.__getitem__ if not long else lambda w: known[w] if w in known else long[w]
        return [list(chain.from_iterable(chain.from_iterable(map(find, p)) if type(p) is list else (self.special[p],) for p in row)) for row in parts]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as the file names no decoder; special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=1)
def coder(text: str) -> WordBPE:
    """One coder for all tasks of a Python worker, so that they share the words it remembers."""
    return WordBPE(text)


def blocks(texts: list[str | None], chars: int):
    """Consecutive (start, end) of at least one text and about ``chars`` characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (string) of every row of ``docs``."""
    return _run(docs, path, "doc_id bigint, ids array<int>, decoded string", lambda bpe, ids: (ids, bpe.decode(ids)))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids (decimal, joined by a space) and of the decoded text."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _run(docs, path, SCHEMA, lambda bpe, ids: (len(ids), sha(" ".join(map(str, ids))), sha(bpe.decode(ids))))


def _run(docs: DataFrame, path: str | None, schema: str, row) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    prepare(spark)
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        bpe = coder(file.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts, BLOCK_CHARS):
                rows = [row(bpe, ids) for ids in bpe.encode([t or "" for t in texts[a:b]])]
                columns = [batch.column(0).slice(a, b - a), *map(list, zip(*rows))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
