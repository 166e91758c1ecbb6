"""Exact encoding and decoding with SentencePiece models of the merge type (BPE).

Encoding is by backtracking: an Aho-Corasick automaton over all pieces gives the longest piece at each position; a piece
may follow another only if merging their joined text anew gives these two pieces back; positions from which no encoding
can go on are kept in a bitfield. Texts are first cut where no piece of the vocabulary reaches across, so equal parts
are encoded once per worker.

The result equals the sentencepiece library's, ids in and out. Defined results: a null or empty text has no ids, and no
ids decode to the empty text. Characters that are no piece become byte pieces. Repeated rows give repeated results, an
empty table an empty one; other columns are carried along, but one named as the result gives way to it. Very long texts are encoded
whole, and runs without blanks in time that grows with their length.
"""

from __future__ import annotations

import itertools
import re
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm.common import add_columns, one_at_a_time, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Parts kept with their ids by one worker, the first to occur. Further ones are encoded once for each step.
CACHED_PARTS = 120_000
#: Text handled at a time within a batch.
STEP_BYTES = 2 << 20
#: Words (after a blank), and what follows a line break without a blank, in texts without other blanks.
_PLAIN = re.compile(r"\A[^ \n▁][^▁]*[^ ▁]\Z")
_PARTS = re.compile(f"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


class PieceModel:
    """A merge-type model; built from the model file's bytes."""

    def __init__(self, model: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = library.get_piece_size()
        self.pieces = [library.id_to_piece(k) for k in range(size)]
        byte = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if library.is_byte(k)}
        hidden = {k for k in range(size) if library.is_control(k) or library.is_unknown(k) or library.is_byte(k)}
        if len(byte) != 256 or any(library.is_unused(k) for k in range(size)):
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        if library.decode(library.encode(" a  B ﬁ ")) != " a  B ﬁ " or library.encode("a", out_type=str)[0][0] != SPACE:
            raise ValueError("only models that leave the text as it is are supported")
        self.byte_ids, self.unknown = byte, library.unk_id()
        self.byte_of = {k: b for b, k in byte.items()}
        self.control = {k for k in range(size) if library.is_control(k)}
        self.score = {p: library.get_score(k) for k, p in enumerate(self.pieces) if k not in hidden}
        self.id_of = {p: k for k, p in enumerate(self.pieces) if k not in hidden}
        if any(c not in self.id_of for p in self.id_of for c in p):
            raise ValueError("each character of a piece has to be a piece")
        self.joints = {pair for p in self.id_of for pair in zip(p, p[1:])}
        self.automaton = ahocorasick.Automaton()
        for piece, k in self.id_of.items():
            self.automaton.add_word(piece, (k, len(piece)))
        self.automaton.make_automaton()
        self.size, self.length = size, [len(p) for p in self.pieces]
        self._shorter: dict[int, int] = {}
        self._fits: dict[int, bool] = {}
        self._segments: dict[str, tuple[int, ...]] = {}
        self._bytes_table()

    # Encoding

    def merged(self, text: str) -> list[int]:
        """The pieces of a text by merging: the best-scored neighbours first, of equals the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return [self.id_of[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' text gives them back; with left -1, the one piece."""
        key = left * self.size + right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 300_000:
                self._fits.clear()
            pair = [right] if left < 0 else [left, right]
            known = self._fits[key] = self.merged("".join(self.pieces[k] for k in pair)) == pair
        return known

    def shorter(self, piece: int) -> int:
        """The longest piece that begins this one and is not it, or -1."""
        known = self._shorter.get(piece)
        if known is None:
            text = self.pieces[piece]
            known = next((self.id_of[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.id_of), -1)
            self._shorter[piece] = known
        return known

    def encode_segment(self, text: str) -> tuple[int, ...]:
        if len(text) == 1:
            return (self.id_of[text],) if text in self.id_of else tuple(self.byte_ids[b] for b in text.encode())
        if text.startswith(SPACE * 2):  # runs of blanks share one score, so their merges are not ranked: leftmost first
            return self.encode_blanks(text)
        longest = [0] * len(text)
        for end, (piece, size) in self.automaton.iter(text):
            longest[end - size + 1] = piece
        length, fits, shorter = self.length, self.fits, self.shorter
        # a bit for each position, set where the rest cannot be encoded from there
        failed, out, at, end = bytearray((len(text) >> 3) + 1), [], 0, len(text)
        piece = longest[0]
        while at < end:
            last = out[-1] if out else -1
            while True:
                stop = at + length[piece]
                if not failed[stop >> 3] >> (stop & 7) & 1 and (last < 0 and stop < end or fits(last, piece)):
                    out.append(piece)
                    at = stop
                    piece = longest[at] if at < end else -1
                    break
                piece = shorter(piece)
                if piece < 0:
                    failed[at >> 3] |= 1 << (at & 7)
                    piece = out.pop()
                    at -= length[piece]
                    break
        return tuple(out)

    def encode_blanks(self, text: str) -> tuple[int, ...]:
        """A run of blanks and what follows it: the last blank goes with the word if they merge, the others join from the left."""
        word = text.lstrip(SPACE)
        run, tail = len(text) - len(word), ()
        if word:
            tail, run = self.encode_segment(SPACE + word), run - 1
            if self.pieces[tail[0]] == SPACE:  # the last blank merged with nothing and is free to join the run
                tail, run = tail[1:], run + 1
        sizes: list[int] = []
        for _ in range(run):
            sizes.append(1)
            while len(sizes) > 1 and SPACE * (sizes[-2] + sizes[-1]) in self.id_of:
                last = sizes.pop()
                sizes[-1] += last
        out = [self.id_of[SPACE * size] for size in sizes]
        return (*out, *tail)

    def encode_part(self, part: str) -> tuple[int, ...]:
        """A part between cuts made beforehand; cut again wherever no piece reaches across."""
        out, begin, segments, joints = [], 0, self._segments, self.joints
        for k in range(1, len(part) + 1):
            if k == len(part) or (part[k - 1], part[k]) not in joints:
                segment = part[begin:k]
                ids = segments.get(segment)
                if ids is None:
                    ids = self.encode_segment(segment)
                    if len(segments) < CACHED_PARTS and len(segment) <= 64:
                        segments[segment] = ids
                out.extend(ids)
                begin = k
        return tuple(out)

    def parts_of(self, text: str) -> list[str]:
        """Cuts before blanks and line breaks. A plain word stands for the word after a blank."""
        if _PLAIN.match(text) and "  " not in text and " \n" not in text:
            return text.replace("\n", " \n").split(" ")
        if not text:
            return []
        found = _PARTS.findall(SPACE + text.replace(" ", SPACE))
        return [p[1:] if p[0] == SPACE and len(p) > 1 and p[1] != SPACE else p for p in found]

    def text_of(self, part: str) -> str:
        return part if part[0] in (SPACE, "\n") else SPACE + part

    def encode(self, text: str | None) -> list[int]:
        return [k for part in self.parts_of(text or "") for k in self.encode_part(self.text_of(part))]

    # Decoding

    def _bytes_table(self) -> None:
        raw = [self._raw(k) for k in range(self.size)]
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_start = np.concatenate(([0], np.cumsum(self.raw_size)))[:-1]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.begins_blank = np.array([p.startswith(SPACE) for p in self.pieces]) & (self.raw_size > 0)

    def _raw(self, k: int) -> bytes:
        if k in self.byte_of:
            return bytes([self.byte_of[k]])
        if k in self.control:
            return b""
        if k == self.unknown:
            return " ⁇ ".encode()
        return self.pieces[k].replace(SPACE, " ").encode()

    def decode(self, ids) -> str:
        return self.decode_batch(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of lists of ids, which stand one after another with n + 1 offsets."""
        sizes = self.raw_size[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        where = np.arange(ends[-1]) + np.repeat(self.raw_start[ids] - ends[:-1], sizes)
        data = self.raw[where].tobytes()
        out, empty = [], bool((sizes == 0).any())
        for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
            first = begin
            while first < end and sizes[first] == 0:  # control pieces
                first += 1
            skip = int(first < end and bool(self.begins_blank[ids[first]]))
            raw = data[int(ends[begin]) + skip : int(ends[end])]
            if not (empty and (sizes[first:end] == 0).any()):  # control pieces part the byte pieces around them
                try:
                    out.append(raw.decode())
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(self._decode_slowly(ids[begin:end].tolist(), skip))
        return out

    def _decode_slowly(self, ids: list[int], skip: int) -> str:
        """As decode, where runs of byte pieces hold bytes that are no UTF-8: each such byte becomes U+FFFD."""
        out, run = [], bytearray()

        def flush():
            at = 0
            while at < len(run):
                size = next((n for n in (1, 2, 3, 4) if _decodes(run[at : at + n])), 0)
                out.append(run[at : at + size].decode() if size else "�")
                at += size or 1
            run.clear()

        for k in ids:
            if k in self.byte_of:
                run.append(self.byte_of[k])
            else:
                flush()
                out.append(self._raw(k).decode())
        flush()
        return "".join(out)[skip:]


def _decodes(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


class _Parts(dict):
    """Numbers of parts, given as they first occur."""

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        return number


class BatchEncoder:
    """Encodes many texts; ids of parts seen before are gathered with numpy."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.numbers = _Parts()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _add(self, parts: list[str], first: int) -> None:
        model = self.model
        encoded = [model.encode_part(model.text_of(p)) for p in parts]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while first + len(parts) > len(self.size):
            self.start, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + total] = np.fromiter((k for ids in encoded for k in ids), np.int32, total)
        self.size[first : first + len(parts)] = sizes
        self.start[first : first + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the n + 1 offsets between texts."""
        known, used = len(self.numbers), self.used
        number, counts, numbers = self.numbers.__getitem__, [0], []
        for text in texts:
            numbers.extend(map(number, self.model.parts_of(text or "")))
            counts.append(len(numbers))
        added = list(itertools.islice(self.numbers, known, None))
        self._add(added, known)
        which = np.array(numbers, np.int64)
        sizes = self.size[which]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.start[which] - ends[:-1], sizes)]
        if len(self.numbers) > CACHED_PARTS:
            for part in added:
                del self.numbers[part]
            self.used = used
        return ids, ends[np.array(counts)]


@one_at_a_time
def model_of(data: bytes) -> tuple[PieceModel, BatchEncoder]:
    model = PieceModel(data)
    return model, BatchEncoder(model)


def _ids_array(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))


def encode_texts(documents: DataFrame, model: str, *, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds each text's ids. The model file, of a fixed size, goes along with the function."""
    data = Path(model).read_bytes()

    def make():
        encoder = model_of(data)[1]
        return lambda texts: [_ids_array(*encoder.encode(texts.to_pylist()))]

    return add_columns(documents, text, f"`{into}` array<int>", make, STEP_BYTES)


def decode_ids(documents: DataFrame, model: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of each list of ids. Null counts as no ids."""
    data = Path(model).read_bytes()

    def make():
        decoder = model_of(data)[0]

        def decode(lists: pa.Array) -> list[pa.Array]:
            found = lists.to_pylist()
            at = np.concatenate(([0], np.cumsum([len(x or ()) for x in found])))
            flat = np.fromiter(itertools.chain.from_iterable(x or () for x in found), np.int64, at[-1])
            return [pa.array(decoder.decode_batch(flat, at), pa.string())]

        return decode

    return add_columns(documents, ids, f"`{into}` string", make, STEP_BYTES)


def round_trip(documents: DataFrame, model: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds each text's ids and the text that these decode to, in one visit to Python."""
    data = Path(model).read_bytes()

    def make():
        piece_model, encoder = model_of(data)

        def both(texts: pa.Array) -> list[pa.Array]:
            flat, at = encoder.encode(texts.to_pylist())
            return [_ids_array(flat, at), pa.array(piece_model.decode_batch(flat, at), pa.string())]

        return both

    return add_columns(documents, text, f"`{ids}` array<int>, `{decoded}` string", make, STEP_BYTES)


def digests(documents: DataFrame, model: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, and digest of what they decode to."""
    return round_trip(documents.select("doc_id", "text"), model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, folder, "documents"), public_tokenizers.path(MODEL))
