"""Operator 2: token counts by a linear longest-match automaton.

Word-piece counts are those of greedy longest match: the longest piece that starts
the word, then the longest continuation piece, and so on; a word that cannot be
covered is one unknown token.  The vocabulary trie has failure links: where no
child matches, the link leads to the node for what remains after the pieces that
greedy matching is by then sure to emit, and the number of those pieces is stored
with the link.  A word is read once, character by character, adding stored counts;
no piece is built.

The vocabulary is a public tokenizer file whose path is a parameter: its pieces
with the word-start mark begin words and the others continue them.  It is read on
the driver and shipped to the tasks; its size is that of the file (at most
``MAX_PIECES`` pieces).

Defined results: null or empty text has no words and no tokens; repeated rows each get
a row; at each place the longest piece wins, and two pieces of one length cannot tie;
texts are read whole; columns besides doc_id and text are not read, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .common import map_rows, prepare, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MAX_PIECES = 1 << 20
#: Distinct words whose counts a task remembers before it starts anew.
REMEMBER = 200_000


def read_pieces(path: str = VOCABULARY) -> tuple[set[str], set[str]]:
    """Pieces that begin a word (with the mark) and pieces that continue one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.get_piece_size() > MAX_PIECES:
        raise ValueError(f"{path} has more than {MAX_PIECES} pieces")
    begin, cont = set(), set()
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            p = sp.id_to_piece(i)
            (begin if p.startswith(MARK) else cont).add(p)
    return begin, cont


class LongestMatch:
    """``nodes[v]``: children by character.  ``fail[v]``: node after the pieces ``pops[v]`` have left, or -1."""

    def __init__(self, begin: set[str], cont: set[str]):
        self.nodes: list[dict[str, int]] = [{}, {}]  # 0 begins a word, 1 continues it
        ends = [False, False]
        for root, pieces in ((0, begin), (1, cont)):
            for p in sorted(pieces):
                v = root
                for c in p:
                    if c not in self.nodes[v]:
                        self.nodes[v][c] = len(self.nodes)
                        self.nodes.append({})
                        ends.append(False)
                    v = self.nodes[v][c]
                ends[v] = True
        self.fail, self.pops = [-1] * len(self.nodes), [0] * len(self.nodes)
        level = [0, 1]
        while level:
            deeper = []
            for u in level:
                for c, v in self.nodes[u].items():
                    deeper.append(v)
                    if ends[v]:
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    z, n = self.fail[u], self.pops[u]
                    while z != -1 and c not in self.nodes[z]:
                        n, z = n + self.pops[z], self.fail[z]
                    if z != -1:
                        self.fail[v], self.pops[v] = self.nodes[z][c], n
            level = deeper

    def count(self, word: str) -> int:
        """Tokens of ``word`` (begun by the mark); 0 where it cannot be covered."""
        nodes, fail, pops = self.nodes, self.fail, self.pops
        u = n = 0
        for c in word:
            while (v := nodes[u].get(c)) is None:
                if fail[u] == -1:
                    return 0
                n, u = n + pops[u], fail[u]
            u = v
        while u != 1:
            if fail[u] == -1:
                return 0
            n, u = n + pops[u], fail[u]
        return n


def greedy(word: str, begin: set[str], cont: set[str]) -> int:
    """The same by trying lengths, for tests."""
    at, n, pieces = 0, 0, begin
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), 0)
        if not end:
            return 0
        at, n, pieces = end, n + 1, cont
    return n


class _Counts(dict):
    def __init__(self, match: LongestMatch):
        self.match = match

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        n = self.match.count(MARK + word.decode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            self[word] = n
        return n


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens (unknown words count one), n_unknown for every row of ``docs``."""
    prepare(docs.sparkSession)
    match = docs.sparkSession.sparkContext.broadcast(LongestMatch(*read_pieces(vocabulary)))

    def make():
        counts = _Counts(match.value)

        def one(doc_id, text):
            each = list(map(counts.__getitem__, (text or "").encode("utf-8", "surrogatepass").split()))
            unknown = each.count(0)
            yield doc_id, len(each), sum(each) + unknown, unknown

        return one

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")


def query(spark, sf_dir) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
