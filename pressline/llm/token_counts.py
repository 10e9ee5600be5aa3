"""Edit-aware token counts.

A text is cut into pre-tokens, which a byte-pair tokenizer encodes one by one. Runs
of pre-tokens are the leaves of a segment tree per document that holds the sums of
characters and of tokens of each subtree. Trees are a column beside the documents
(``with_trees``) that can be stored and handed in again (``apply_edits``). An edit
finds its leaves by descending the character sums. Only those leaves are cut and
encoded again, from a pre-token boundary that the edit cannot have moved until a
boundary of the old text is met behind it; then the subtree sums above the changed
leaves are updated. All edits of a text are made in one pass over it.

Why two characters suffice on the left: the pattern reads no character behind its
position and at most one beyond the pre-token's end, so a boundary that lies two
or more characters before the edit stays.

Defined cases: a null text is empty and has no tokens; edits address code points
of the old text, are applied by start and then end, and one that overlaps an
earlier one, or lies outside the text, is left out; edits at one place and of one
length go by their replacement; edits without a doc_id apply to nothing; repeated rows
are counted row by row (edits of a doc_id apply to each); a text of any length costs
time in proportion to it when its tree is built, and to what is touched afterwards; an
empty table gives an empty result; further columns, whatever their names, are kept
inside ``document`` by the two steps and ignored by ``counts``.
"""

from __future__ import annotations

import base64
import re
import uuid

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table
from .secret_scan import known_spans

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to the rank file (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of a leaf.
LEAF = 64
#: Characters before an edit in which boundaries may move.
CONTEXT = 2

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
ADDRESS = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])")


class Encoder(dict):
    """Pre-token -> number of tokens; forgets when it holds too many."""

    LIMIT = 500_000

    def __init__(self, ranks: bytes):
        import tiktoken

        super().__init__()
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self._bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self._cut = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        n = self[piece] = len(self._bpe.encode_ordinary(piece))
        return n

    def pieces(self, text: str) -> list[str]:
        return self._cut.findall(text)

    def matches(self, text: str, at: int):
        return self._cut.finditer(text, at)


def rank_file(path: str = TOKENIZER) -> bytes:
    """The vocabulary, read on the driver; about a megabyte."""
    with open(path, "rb") as f:
        return f.read()


_encoders: dict[str, Encoder] = {}


def _encoder(sent, name: str) -> Encoder:
    """The encoder of the broadcast vocabulary, made once a worker."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(sent.value)
    return _encoders[name]


class Tree:
    """Segment tree over the leaves: sums of characters and tokens, node i over 2i and 2i+1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        size = 1
        while size < max(1, len(chars)):
            size *= 2
        self.size, self.leaves = size, len(chars)
        self.chars = [0] * size + chars + [0] * (size - len(chars))
        self.tokens = [0] * size + tokens + [0] * (size - len(tokens))
        for i in range(size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if position >= start + self.chars[i] and i + 1 < 2 * self.size and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def update(self, leaves: dict[int, tuple[int, int]]) -> None:
        """New sums of some leaves; every node above them is summed once."""
        for k, (c, t) in leaves.items():
            self.chars[self.size + k], self.tokens[self.size + k] = c, t
        above = {(self.size + k) // 2 for k in leaves}
        while above and above != {0}:
            for i in above:
                self._sum(i)
            above = {i // 2 for i in above}

    def leaf_sums(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size : self.size + self.leaves], self.tokens[self.size : self.size + self.leaves]


def _sums(pieces: list[tuple[int, int]], per: int) -> list[tuple[int, int]]:
    """(characters, tokens) of runs of ``per`` pre-tokens."""
    return [(sum(p[0] for p in pieces[i : i + per]), sum(p[1] for p in pieces[i : i + per])) for i in range(0, len(pieces), per)]


def build(text: str, encoder: Encoder) -> Tree:
    pieces = encoder.pieces(text)
    tokens = list(map(encoder.__getitem__, pieces))
    cuts = range(0, len(pieces), LEAF)
    return Tree([sum(map(len, pieces[i : i + LEAF])) for i in cuts], [sum(tokens[i : i + LEAF]) for i in cuts])


def usable(text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out, end = [], 0
    for a, b, new in sorted(edits):
        if end <= a <= b <= len(text):
            out.append((a, b, new))
            end = b
    return out


def edit(text: str, tree: Tree, edits: list[tuple[int, int, str]], encoder: Encoder) -> tuple[str, Tree, int]:
    """The edited text, its tree and how many pre-tokens were encoded for it. ``edits``
    are in order and do not overlap."""
    if not edits:
        return text, tree, 0
    parts, at = [], 0
    for a, b, new in edits:
        parts += [text[at:a], new]
        at = b
    after = "".join([*parts, text[at:]])
    # each edit with what it shifts the text behind it by
    shifts, shift = [], 0
    for a, b, new in edits:
        shift += len(new) - (b - a)
        shifts.append(shift)
    regions: list[tuple[int, int, list[tuple[int, int]]]] = []
    encoded, k = 0, 0
    while k < len(edits):
        first, start = tree.find(max(0, edits[k][0] - CONTEXT))
        last, end = first, start  # old leaves in the region, and where the last of them ends
        pieces: list[tuple[int, int]] = []
        here = start + (shifts[k - 1] if k else 0)
        matches = encoder.matches(after, here)
        while True:
            # the region must hold every edit that may move a boundary before its end
            while last < tree.leaves and (end < edits[k][1] or last == first):
                end += tree.chars[tree.size + last]
                last += 1
            if k + 1 < len(edits) and edits[k + 1][0] - CONTEXT < end:
                k += 1
                continue
            if here == end + shifts[k]:
                break
            if here > end + shifts[k] and last < tree.leaves:
                end += tree.chars[tree.size + last]
                last += 1
                continue
            m = next(matches, None)
            if m is None:
                last = tree.leaves
                break
            pieces.append((len(m[0]), encoder[m[0]]))
            here = m.end()
        encoded += len(pieces)
        regions.append((first, last, pieces))
        k += 1
    if all(len(p) <= 2 * LEAF * (last - first) for first, last, p in regions):
        for first, last, p in regions:
            sums = _sums(p, max(1, -(-len(p) // max(1, last - first))))
            tree.update({first + i: sums[i] if i < len(sums) else (0, 0) for i in range(last - first)})
        return after, tree, encoded
    # leaves that have grown are cut again; no other one is encoded for that
    leaves, at = [], 0
    old = list(zip(*tree.leaf_sums()))
    for first, last, p in regions:
        leaves += [*old[at:first], *_sums(p, LEAF)]
        at = last
    leaves += old[at:]
    return after, Tree([c for c, _ in leaves], [t for _, t in leaves]), encoded


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """What cleaning replaces in place: secrets, e-mail addresses and IP addresses."""
    out = [(a, b, "[SECRET]") for a, _, b in known_spans(text)]
    if "@" in text:
        out += [(*m.span(), "[EMAIL]") for m in EMAIL.finditer(text)]
    out += [(*m.span(), "[ADDRESS]") for m in ADDRESS.finditer(text)]
    return usable(text, out)


_TREE = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
TREE = "struct<chars:array<int>,tokens:array<int>>"
EDITS = "array<struct<start:int,end:int,replacement:string>>"


def _sent(spark: SparkSession, tokenizer: str):
    return spark.sparkContext.broadcast(rank_file(tokenizer)), uuid.uuid4().hex


def _beside(rows: DataFrame, text_at: int, run, more: str) -> DataFrame:
    """The first column of ``rows``, document, and the columns that ``run`` makes of the
    document's text (its field ``text_at``) and the other columns."""
    document = rows.schema.fields[0]
    added = StructType.fromDDL(more).fields

    def map_batches(it):
        for b in it:
            text = b.column(0).field(text_at).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *run([text, *b.columns[1:]])], names=[document.name, *(f.name for f in added)])

    return rows.mapInArrow(map_batches, StructType([document, *added]))


def with_trees(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """document (the row) and tree: characters and tokens of the leaves of its segment tree."""
    sent, name = _sent(docs.sparkSession, tokenizer)

    def run(columns):
        encoder = _encoder(sent, name)
        trees = (build(x or "", encoder).leaf_sums() for x in columns[0].to_pylist())
        return [pa.array([{"chars": c, "tokens": t} for c, t in trees], _TREE)]

    return _beside(docs.select(F.struct("*").alias("document")), docs.columns.index("text"), run, f"tree {TREE}")


def apply_edits(trees: DataFrame, edits: DataFrame | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """document, n_chars, n_tokens, n_edits, n_reencoded, n_chars_after, n_tokens_after,
    text_after and tree_after of rows (document, tree). ``edits`` has doc_id, start, end,
    replacement; without it the cleaning edits are made."""
    if edits is None:
        rows = trees.select("document", "tree", F.expr(f"cast(null as {EDITS})").alias("edits"))
    else:
        wanted = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("replacement", F.lit("")).alias("replacement"))
        grouped = edits.groupBy(F.col("doc_id").cast("long").alias("edited")).agg(F.collect_list(wanted).alias("edits"))
        rows = trees.join(grouped, F.col("document")["doc_id"].cast("long") == F.col("edited"), "left").select("document", "tree", F.coalesce("edits", F.expr(f"cast(array() as {EDITS})")).alias("edits"))
    sent, name = _sent(trees.sparkSession, tokenizer)

    def run(columns):
        encoder = _encoder(sent, name)
        out: list[list] = [[] for _ in range(8)]
        for x, stored, asked in zip(*(c.to_pylist() for c in columns)):
            x, tree = x or "", Tree(stored["chars"], stored["tokens"])
            before = tree.total
            todo = cleaning_edits(x) if asked is None else usable(x, [(e["start"], e["end"], e["replacement"]) for e in asked])
            after, tree, encoded = edit(x, tree, todo, encoder)
            c, t = tree.leaf_sums()
            for column, v in zip(out, (len(x), before, len(todo), encoded, len(after), tree.total, after, {"chars": c, "tokens": t})):
                column.append(v)
        return [pa.array(v, t) for v, t in zip(out, (*[pa.int64()] * 6, pa.string(), _TREE))]

    text_at = trees.schema["document"].dataType.fieldNames().index("text")
    return _beside(rows, text_at, run, f"n_chars long, n_tokens long, n_edits long, n_reencoded long, n_chars_after long, n_tokens_after long, text_after string, tree_after {TREE}")


def counts(docs: DataFrame, edits: DataFrame | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and the token counts before and after the edits."""
    edited = apply_edits(with_trees(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer), edits, tokenizer)
    return edited.select("document.doc_id", "n_chars", "n_tokens", "n_edits", "n_reencoded", "n_chars_after", "n_tokens_after")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"))
