"""SentencePiece encoding and decoding: N-best segmentation by backward A* over the piece lattice."""

from __future__ import annotations

import re
import string
import zlib
from array import array
from bisect import insort

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fresh, held, mapped, table, with_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
SPACE = "▁"
#: Segments that a Python worker remembers, twice over: those of late and those before.
REMEMBERED = 250_000


def load_pieces(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is n for text, b for a byte, c for what text never becomes."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "b" if sp.is_byte(i) else "c" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "n"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.vocab_size())]


class Cutter:
    """Parts of a text that no piece of the vocabulary reaches over, in any context.

    A piece lies over a place between two characters only if the two stand side by side in it. The cutter's places are
    those before a white space that follows something else, on both sides of a line's end or tab that is in no longer
    piece, and before a mark that stands behind a plain character. Plain is what isn't punctuation nor, like ², stands
    before punctuation in some piece without being a letter; marks are the punctuation that follows no plain character
    in any piece. Should a pair of a piece be one of these places after all, texts are not cut.
    """

    def __init__(self, pieces: list[str]):
        pairs = {x for piece in pieces for x in zip(piece, piece[1:])}
        inside = {c for x in pairs for c in x}
        self.alone = "".join(c for c in "\n\t\r" if c not in inside)
        sticky = {x for x, y in pairs if y in string.punctuation and not x.isalpha()}
        self.other = "".join(sorted({SPACE, *self.alone, *string.punctuation, *sticky}))
        self.marks = "".join(sorted(set(string.punctuation) - {y for x, y in pairs if x not in self.other}))
        self.whole = any((y == SPACE != x) or x in self.alone or y in self.alone or (x not in self.other and y in self.marks) for x, y in pairs)
        plain = f"[^{re.escape(self.other)}]++(?=[{re.escape(self.marks)}{SPACE}{self.alone}]|\\Z)"
        cut = f"{SPACE}*(?:{plain}|[^{SPACE}{self.alone}]+)|{SPACE}+" + (f"|[{self.alone}]" if self.alone else "")
        self.find = re.compile(r"(?s).+" if self.whole else cut).findall


class Lattice:
    """Segmentation of texts into pieces of a vocabulary.

    A segmentation's score is the sum of its pieces' scores, which are the model file's own. A character that no piece
    covers is spelled in bytes, at 10 below the worst score of a text piece for the character.
    """

    def __init__(self, pieces: list[tuple[str, float, str]], n_best: int = N_BEST, remembered: int = REMEMBERED):
        self.n_best, self.remembered = n_best, remembered
        #: Nodes of a trie: the next nodes by character, and the piece that ends here as (score, ids).
        self.trie: dict[str, list] = {}
        self.bytes = [-1] * 256
        self.text: list[bytes] = []
        worst = min((s for _, s, k in pieces if k == "n" and s > -1e8), default=0.0)
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == "b":
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.text.append(bytes([value]))
                continue
            self.text.append(piece.replace(SPACE, " ").encode() if kind == "n" else b"")
            if kind != "n":
                continue
            kids = self.trie
            for c in piece:
                node = kids.setdefault(c, [{}, None])
                kids = node[0]
            node[1] = (score, array("i", (i,)).tobytes())
        self.spelled = worst - 10
        self.cut = Cutter([p for p, _, k in pieces if k == "n"]).find
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.paths: dict[str, list] = {}

    def _forward(self, s: str):
        """Arcs (from, score, ids) of the lattice of s by where they end, forward Viterbi scores, and the best arc into each place."""
        n, trie = len(s), self.trie
        forward, back, into = [0.0] + [-1e300] * n, [None] * (n + 1), [[] for _ in range(n + 1)]
        for i in range(n):
            at, kids, single = forward[i], trie, False
            for j in range(i, n):
                node = kids.get(s[j])
                if node is None:
                    break
                kids, piece = node
                if piece is not None:
                    arc = (i, *piece)
                    into[j + 1].append(arc)
                    if i == j:
                        single = True
                    score = at + piece[0]
                    if score > forward[j + 1]:
                        forward[j + 1] = score
                        back[j + 1] = arc
            if not single:
                arc = (i, self.spelled, array("i", [self.bytes[b] for b in s[i].encode("utf-8", "surrogatepass")]).tobytes())
                into[i + 1].append(arc)
                if at + self.spelled > forward[i + 1]:
                    forward[i + 1] = at + self.spelled
                    back[i + 1] = arc
        return into, forward, back

    def segment(self, s: str, most: int) -> tuple[list[tuple[bytes, float]], float]:
        """The `most` best segmentations of s, best first: ids, in 32 bits each, and score; and what the next one would lose.

        A* from the end of s to its start. Forward Viterbi scores are exact for what is left of a backward path, so a
        path's estimate falls only where it leaves the best arc into a place: the search walks down best arcs at once,
        and what waits is one path for each arc beside them, ordered by estimate. As each of those ends as a segmentation of
        just that estimate, no more of them wait than are still wanted. Among equal estimates the one met first goes
        first.
        """
        into, forward, back = self._forward(s)
        out, waiting, order = [], [], 0
        at, tail, score = len(s), None, 0.0
        best = forward[at]
        while True:
            room, worst = most - len(out), 1e300
            if len(waiting) >= room:
                del waiting[room:]
                worst = waiting[-1][0]
            while at:
                arc = back[at]
                arcs = into[at]
                if len(arcs) > 1:
                    for other in arcs:
                        if other is not arc:
                            loss = best - (forward[other[0]] + other[1] + score)
                            if loss < worst:
                                order += 1
                                insort(waiting, (loss, order, other, score, tail))
                                if len(waiting) >= room:
                                    del waiting[room:]
                                    worst = waiting[-1][0]
                score += arc[1]
                tail = (arc, tail)
                at = arc[0]
            total, ids = 0.0, []
            while tail:
                (_, own, piece), tail = tail
                total += own
                ids.append(piece)
            out.append((b"".join(ids), total))
            if len(out) == most or not waiting:
                return out, waiting[0][0] if waiting else 1e300
            _, _, arc, score, tail = waiting.pop(0)
            score += arc[1]
            tail = (arc, tail)
            at = arc[0]

    def n_best_of(self, text: str | None) -> tuple[list[float], list[bytes]]:
        """Scores and ids, in 32 bits each, of the n_best segmentations of a whole text, best first.

        A segmentation of the text is one of each of its segments. The k-th best strays from the best in segments of
        the k - 1 smallest losses only, loss being what a segment's second best lacks, so those alone are put together.
        """
        if not text:
            return [0.0], [b""]
        young, old, found = self.young, self.old, []
        segments = self.cut(SPACE + text.replace(" ", SPACE))
        for s in segments:
            entry = young.get(s)
            if entry is None:
                entry = old.get(s)
                if entry is None:
                    (first,), loss = self.segment(s, 1)
                    entry = (*first, loss)
                if len(young) >= self.remembered:
                    self.old, self.young = old, young = young, {}
                if len(s) < 64:
                    young[s] = entry
            found.append(entry)
        parts = [e[0] for e in found]
        total, few = sum([e[1] for e in found]), self.n_best - 1
        if not few:
            return [total], [b"".join(parts)]
        loss = np.array([e[2] for e in found])
        near = np.flatnonzero(loss <= np.partition(loss, few - 1)[few - 1]) if len(loss) > few else np.arange(len(loss))
        ways = [(0.0, ())]
        for k in near[np.argsort(loss[near], kind="stable")][:few].tolist():
            paths = self._remembered(segments[k])
            ways = sorted((w[0] + paths[0][1] - p[1], w[1] + ((k, p[0]),) * (p is not paths[0])) for w in ways for p in paths)[: self.n_best]
        ids = []
        for _, changes in ways:
            for k, other in changes:
                parts[k] = other
            ids.append(b"".join(parts))
            for k, _ in changes:
                parts[k] = found[k][0]
        return [total - w[0] for w in ways], ids

    def encode(self, text: str | None, alternatives: bool = False):
        """(scores, ids, others): the scores of the n_best segmentations of a whole text, the ids of the best and, if
        asked for, those of the others."""
        scores, ids = self.n_best_of(text)
        first, *others = (array("i", x) for x in (ids if alternatives else ids[:1]))
        return scores, first, others

    def _remembered(self, s: str) -> list[tuple[bytes, float]]:
        paths = self.paths.get(s)
        if paths is None:
            if len(self.paths) >= 20_000:
                self.paths.clear()
            paths, _ = self.segment(s, self.n_best)
            if len(s) < 64:
                self.paths[s] = paths
        return paths

    def decode(self, ids) -> str:
        """The text of a sequence of ids: pieces joined, bytes read as UTF-8, the space before the first word taken off."""
        text = self.text
        return b"".join([text[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")

    def decode_any(self, ids) -> str:
        """decode() of ids that may be null or not of the vocabulary: each of these is a U+FFFD."""
        known = range(len(self.text))
        return b"".join([self.text[i] if i in known else b"\xef\xbf\xbd" for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def _shipped(docs: DataFrame, model: str, n_best: int, remembered: int = REMEMBERED):
    """A function that gives a Python worker its lattice: one for all of its tasks."""
    pieces = load_pieces(model)
    key = ("lattice", model, zlib.crc32(repr(pieces).encode()), n_best, remembered)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    return lambda: held(key, lambda: Lattice(sent.value, n_best, remembered))


def encoded(docs: DataFrame, n_best: int = N_BEST, model: str = MODEL, alternatives: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """docs with scores (of up to n_best segmentations, best first), pieces (the best one's ids) and round_trip, whether
    decoding them gives the text back; alternatives adds the ids of the others. What a worker remembers costs about 300
    bytes a segment, twice over; results don't depend on it.

    Whole texts are segmented; the vocabulary, which doesn't grow with the data, is read by the driver and broadcast. A
    null or empty text has one segmentation, of no pieces, with score 0. The character U+2581 is written as a space, so a text that
    holds it comes back with spaces. A text of one unbroken word is one lattice, linear in its length. Other columns pass, but for those of
    the names that are added, which are replaced.
    """
    ready = _shipped(docs, model, n_best, remembered)
    added = {"scores": F.array(F.lit(0.0)), "pieces": F.array(F.lit(0)), "round_trip": F.lit(True)} | ({"others": F.array(F.array(F.lit(0)))} if alternatives else {})
    kept = docs.drop(*added).columns
    rows, at = with_text(docs.drop(*added), docs["text"])
    width = len(kept)
    schema = rows.select(*map(column, kept), *[c.alias(k) for k, c in added.items()]).schema
    columns = schema.names

    def run(batches):
        lattice = ready()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                scores, best, same, others = [], [], [], []
                for x in part.columns[at]:
                    text = x.as_py()
                    s, ids, more = lattice.encode(text, alternatives)
                    scores.append(s)
                    best.append(np.frombuffer(ids, np.int32))
                    others.append(more)
                    same.append(lattice.decode(ids) == (text or "").replace(SPACE, " "))
                cols = [*part.columns[:width], pa.array(scores, pa.list_(pa.float64())), pa.array(best, pa.list_(pa.int32())), pa.array(same)]
                if alternatives:
                    cols.append(pa.array(others, pa.list_(pa.list_(pa.int32()))))
                yield pa.RecordBatch.from_arrays(cols, columns)

    return mapped(rows, run, schema)


def decoded(rows: DataFrame, pieces: str = "pieces", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """rows with the text of a column of ids; a column of that name is replaced.

    Null stays null, and no ids are an empty text. A null id, or one that the vocabulary has not, gives a U+FFFD. Other
    columns pass, whatever their names; an empty table gives an empty result.
    """
    ready = _shipped(rows, model, 1)
    kept = [c for c in rows.columns if c != text]
    ids = rows.select(*map(column, kept), column(pieces).cast("array<long>").alias(fresh(rows.columns, "__ids")))
    schema = ids.select(*map(column, kept), F.lit(None).cast("string").alias(text)).schema
    names = schema.names

    def run(batches):
        lattice = ready()
        for batch in batches:
            found = [None if x.as_py() is None else lattice.decode_any(x.as_py()) for x in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names)

    return mapped(ids, run, schema)


def digest(docs: DataFrame, n_best: int = N_BEST, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, n_found, score, margin, pieces_crc, n_best_crc and round_trip of every row.

    n_pieces and score are the best segmentation's; margin is what the second best loses (null without one); the CRC-32
    are over the ids as little-endian 32-bit numbers, of the best and of the n_found best one after the other. A null or
    empty text has one segmentation, of no pieces, score 0 and CRC 0. Repeated rows and null ids come back as often as
    they are there; other columns are not read, whatever their names; an empty table gives an empty result.
    """
    ready = _shipped(docs, model, n_best)
    schema = "doc_id long, n_pieces long, n_found int, score double, margin double, pieces_crc long, n_best_crc long, round_trip boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches):
        lattice = ready()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part, out = batch.slice(k, 256), []
                for doc_id, x in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    text = x.as_py()
                    scores, ids = lattice.n_best_of(text)
                    every = 0
                    for one in ids:
                        every = zlib.crc32(one, every)
                    same = lattice.decode(array("i", ids[0])) == (text or "").replace(SPACE, " ")
                    out.append((doc_id, len(ids[0]) // 4, len(ids), scores[0], scores[0] - scores[1] if len(scores) > 1 else None, zlib.crc32(ids[0]), every, same))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document: nulls, empty, long and repeated texts as there."""
    return digest(table(spark, sf_dir, "documents"))
