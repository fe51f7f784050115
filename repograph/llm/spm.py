"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The pass goes over a text's characters and keeps, for each boundary, the best piece that ends there
and so a backpointer to the boundary before it.  No piece is longer than the longest of the model,
so only a window of that many boundaries can still be pointed back to.  As soon as the backpointer
paths from all boundaries in the window run through one boundary, the ids before it are final: they
are committed and dropped, so memory does not grow with the text.

For a unigram model "best" is the largest sum of scores.  For a BPE model (merges by rank) it is the
one piece with which the encoding of the prefix can end: the encoding of a prefix is fixed by
the encoding up to the piece and by whether the two pieces at the seam stay apart when
merged together, which is a property of the pair (kept in a table).  Both give the library's ids.

A character that no piece covers becomes its bytes (byte fallback) or the unknown id.  Pieces that
start a word begin with the space mark; where no piece of the model has the mark behind another
character, a boundary before a mark that follows one is one where all paths meet and all is committed.  What lies
between two such boundaries, a word, is remembered with its ids in a table of bounded size.

Defined results: a null text is empty; an empty text has no ids; decoding gives back the text for
models with byte fallback and an identity normaliser (a text's own U+2581 comes back as a space, as
with the library); repeated rows and null ids keep their rows; a table without rows gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support

MARK = "▁"
RESULT = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean"
ENCODED = "doc_id long, ids array<int>"
CHUNK = 4096  # characters that go into the pass at once
REMEMBERED = 300_000  # words in the table of those met last; the table before it is kept as well


class Model:
    """Pieces and scores of a model file, with the two ways to choose among them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with an identity normaliser that keep white space are taken")
        self.prefix = spec.add_dummy_prefix
        self.bpe = proto.trainer_spec.model_type == 2
        if proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("unigram and BPE models are taken")
        kinds = pb.ModelProto.SentencePiece
        self.pieces = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined pieces are not taken")
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.plain = {i: p for p, i in self.normal.items()} | {i: chr(b) for i, b in self.of_byte.items() if b < 128}
        self.longest = max(map(len, self.normal))
        self.least = min((self.scores[i] for i in self.normal.values()), default=0.0) - 10.0
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.normal)
        self.apart: dict[tuple[str, str], bool] = {}
        # For each ending of a piece (a piece is one) its id where it is a piece, else -1.
        self.endings = {p[i:]: -1 for p in self.normal for i in range(len(p))} | self.normal
        self.seams: dict[int, bool] = {}  # of two ids, whether they stay apart
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    # -- BPE at a seam ----------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the adjacent pair whose union scores best, leftmost of equals, again and again."""
        parts, normal, scores = list(text), self.normal, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = normal.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, at = scores[found], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays_apart(self, left: str, right: str) -> bool:
        key = left, right
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            found = self.apart[key] = self.merged(left + right) == [left, right]
        return found

    # -- the pass ---------------------------------------------------------------------------

    def committed(self, chunks):
        """Lists of the pieces of a text that comes in chunks of characters, as soon as they are final.

        A piece is its id, or for a character that is no piece the negative of its code point less 1.  Boundaries are counted
        from the window's start; of the piece that ends at boundary i, back[i] is the length and last[i] the piece.
        """
        longest, bpe, scores, least = self.longest, self.bpe, self.scores, self.least
        ending, known, none = self.endings.get, self.seams.get, -2
        window, n, back, last, best = "", 0, [0], [None], [0.0]
        for chunk in chunks:
            window += chunk
            while n < len(window):
                n += 1
                begin = n - 1
                lowest = n - longest if n > longest else 0
                found = ending(window[begin])
                chosen, piece, most = begin, found if found is not None and found >= 0 else -ord(window[begin]) - 1, None
                if not bpe:
                    most = best[begin] + (scores[found] if piece >= 0 else least)
                elif found is not None:
                    before = last[begin]
                    if before is not None:
                        held = known(before << 32 | found) if before >= 0 and found >= 0 else None
                        if not (self.seam(before, piece) if held is None else held):
                            chosen = None
                # Longer pieces: the first that fits for BPE, all for unigram; none beyond what is the ending of a piece.
                while found is not None and begin > lowest and (chosen is None or not bpe):
                    begin -= 1
                    found = ending(window[begin:n], none)
                    if found < 0:
                        if found == none:
                            break
                        continue
                    if bpe:
                        before = last[begin]
                        if before is not None:
                            held = known(before << 32 | found) if before >= 0 else None
                            if not (self.seam(before, found) if held is None else held):
                                continue
                        chosen, piece = begin, found
                    elif best[begin] + scores[found] >= most:  # of equals the longer piece, as the library has it
                        most, chosen, piece = best[begin] + scores[found], begin, found
                back.append(n - chosen if chosen is not None else 1)
                last.append(piece)
                if not bpe:
                    best.append(most)
                if n >= 2 * longest:
                    # Paths from all boundaries that a later piece may point back to; where they first meet is final.
                    meet = self.meeting(back, n, longest)
                    if meet:
                        yield self.traced(back, last, meet)
                        window, n = window[meet:], n - meet
                        back[: meet + 1], last[: meet + 1] = [0], [last[meet]]
                        if not bpe:
                            del best[:meet]
        yield self.traced(back, last, n)

    def seam(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart when they are merged together."""
        if left < 0 or right < 0:
            return self.stays_apart(self.text_of(left), self.text_of(right))
        key = left << 32 | right
        found = self.seams.get(key)
        if found is None:
            if len(self.seams) > 2_000_000:
                self.seams.clear()
            a, b = self.pieces[left], self.pieces[right]
            found = self.seams[key] = self.merged(a + b) == [a, b]
        return found

    def text_of(self, piece: int) -> str:
        return self.pieces[piece] if piece >= 0 else chr(-piece - 1)

    def stream(self, chunks):
        """The pieces as strings."""
        for pieces in self.committed(chunks):
            yield from map(self.text_of, pieces)

    @staticmethod
    def meeting(back: list[int], n: int, longest: int) -> int:
        """The last boundary that the paths from all of the last ``longest`` boundaries share; 0 if there is none."""
        ends = set(range(n - longest + 1, n + 1))
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(last - back[last])
        return ends.pop()

    @staticmethod
    def traced(back: list[int], last: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(last[end])
            end -= back[end]
        out.reverse()
        return out

    # -- texts ------------------------------------------------------------------------------

    def ids_of_word(self, word: str) -> tuple[int, ...]:
        """Ids of a word, or of any text: it goes through the pass in chunks, so the window is all that is copied."""
        ids: list[int] = []
        unknown = False
        for pieces in self.committed([word] if len(word) <= CHUNK else (word[i : i + CHUNK] for i in range(0, len(word), CHUNK))):
            for piece in pieces:
                if piece >= 0:
                    ids.append(piece)
                elif self.bytes:
                    ids += [self.bytes[b] for b in chr(-piece - 1).encode()]
                elif not unknown:  # neighbours without a piece are one unknown
                    ids.append(self.unknown)
                unknown = piece < 0
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if not self.by_word or not self.bytes:
            return list(self.ids_of_word(text))
        # Every path has a boundary before a mark that follows another character: there the pass commits all, and what
        # lies between two such boundaries has the same ids wherever it stands.
        words, older, ids = self.words, self.older, []
        for word in WORD.findall(text):
            found = words.get(word)
            if found is None:
                found = older.get(word) or self.ids_of_word(word)
                if len(word) <= 64:
                    if len(words) >= REMEMBERED:
                        self.older, self.words = words, {}
                        words, older = self.words, self.older
                    words[word] = found
            ids += found
        return ids

    def decode(self, ids) -> str:
        """Text of ids: bytes that follow each other are put together; bytes that are no UTF-8 become U+FFFD each."""
        try:  # no byte beyond ASCII, unknown or control among them
            text = "".join([self.plain[i] for i in ids]).replace(MARK, " ")
            return text[1:] if self.prefix and text.startswith(" ") else text
        except KeyError:
            pass
        out, held = bytearray(), bytearray()

        def flush():
            if held:
                out.extend(held.decode("utf-8", "replace").encode())
                held.clear()

        for i in ids:
            if i in self.of_byte:
                held.append(self.of_byte[i])
                continue
            flush()
            if i == self.unknown:
                out.extend(" ⁇ ".encode())
            elif i not in self.silent:
                out.extend(self.pieces[i].encode())
        flush()
        text = out.decode().replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@functools.lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each text."""
    support.ready(docs.sparkSession)

    def task(batches):
        m = model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m.encode(t.as_py()) for t in part.column(1)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(task, ENCODED)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row's ids."""
    support.ready(encoded.sparkSession)

    def task(batches):
        m = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(task, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Number and checksum (little-endian 32-bit) of each text's ids, and whether they decode to the text again."""
    support.ready(docs.sparkSession)

    def task(batches):
        m = model(path)
        for batch in batches:
            rows = ([], [], [])
            for t in batch.column(1):
                text = t.as_py()
                ids = m.encode(text)
                rows[0].append(len(ids))
                rows[1].append(zlib.crc32(np.asarray(ids, "<u4").tobytes()))
                rows[2].append(m.decode(ids) == text.replace(MARK, " "))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(task, RESULT)
