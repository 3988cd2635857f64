"""SentencePiece ids with the source bytes of every piece, and texts from ids.

1. Normalisation. The model's compiled character map is a double-array trie over UTF-8 keys; at
   each character the longest key that fits is replaced, else the character stays. All places
   of a slice of text walk the trie at once. Blanks become the space symbol, and one is put
   before the text. Every normalised byte keeps the offset of the source character it came from.
2. Encoding. No piece of the vocabulary holds a space symbol behind another character, so no
   piece crosses the start of a run of blanks, and text is cut there into chunks. Distinct chunks are
   encoded once per worker by the sentencepiece library and kept by their bytes.
3. Projection. A piece's place in the normalised text gives, through the offsets, its bytes in
   the source. A character that falls back to bytes belongs to its last byte; the others are empty.

Ids and decoded texts equal the library's. Invalid UTF-8 counts as U+FFFD, as there. Vocabularies
with user-defined symbols, with blanks inside pieces or as suffixes, or without the blank before the text are refused.

A null text is empty and has no ids. Texts are never cut; memory follows slices, the longest
text and a bounded table of chunks. Repeated rows and null doc_ids are kept as rows of their own,
an empty table gives an empty result, and only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relevia.llm.textkit import list_array, slices

SPACE = 0x20
SYMBOL = "▁"
#: Chunks kept per worker, and the bytes they may have in all; when full, the table starts anew.
KEPT_CHUNKS, KEPT_BYTES = 1 << 19, 16 << 20


def default_model() -> str:
    """Path of the public model of 32 000 pieces on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharMap:
    """The compiled character map: longest keys that start at each byte of a text."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", offset=4, count=size // 4) if size else np.zeros(0, np.uint32)
        self.strings = blob[4 + size :]

    def _step(self, node: np.ndarray) -> np.ndarray:
        unit = self.units[node].astype(np.int64)
        return node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))

    def matches(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where some key fits, the length of the longest one, and where its replacement begins."""
        n = len(data)
        length, value = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        if len(self.units):
            at = np.arange(n)
            node = np.full(n, self._step(np.zeros(1, dtype=np.int64))[0])
            depth = 0
            while len(at):
                byte = data[at + depth].astype(np.int64)
                node = node ^ byte
                inside = node < len(self.units)
                at, node, byte = at[inside], node[inside], byte[inside]
                unit = self.units[node].astype(np.int64)
                # the label of an inner unit is its byte; a leaf's has its top bit set
                on = (unit & 0x800000FF) == byte
                at, node, unit = at[on], node[on], unit[on]
                node = self._step(node)
                depth += 1
                leaf = np.flatnonzero(unit >> 8 & 1)
                length[at[leaf]] = depth
                value[at[leaf]] = self.units[node[leaf]].astype(np.int64) & 0x7FFFFFFF
                more = at + depth < n
                at, node = at[more], node[more]
        places = np.flatnonzero(length)
        return places, length[places], value[places]

    def replacement(self, value: int) -> bytes:
        return self.strings[value : self.strings.index(b"\0", value)]


def _valid(text: bytes) -> tuple[bytes, np.ndarray | None]:
    """A text with U+FFFD for each byte that is no UTF-8, and the source place of each byte if that changed any."""
    try:
        text.decode()
        return text, None
    except UnicodeDecodeError:
        out, places, at = [], [], 0
        while at < len(text):
            size = 1 if text[at] < 0x80 else 2 if text[at] < 0xE0 else 3 if text[at] < 0xF0 else 4
            char = text[at : at + size]
            try:
                char.decode()
            except UnicodeDecodeError:
                char, size = "�".encode(), 1
            out.append(char)
            places.append(np.arange(at, at + size) if size == len(char) else np.full(len(char), at))
            at += size
        return b"".join(out), np.concatenate(places)


class Normalizer:
    """Normalises the texts of a slice; blanks stay blanks here and stand for the space symbol."""

    def __init__(self, charmap: bytes, squeeze: bool) -> None:
        self.map = CharMap(charmap)
        self.squeeze = squeeze
        symbol = SYMBOL.encode()
        self.symbol = [symbol[k] for k in range(3)]

    def _replaced(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after longest-prefix replacement, and for each the start of its source character."""
        lead = (data & 0xC0) != 0x80
        heads = np.flatnonzero(lead)
        origin = np.repeat(heads, np.diff(np.append(heads, len(data))))
        places, lengths, values = self.map.matches(data)
        chosen, end = [], 0
        for at, size, value in zip(places.tolist(), lengths.tolist(), values.tolist()):
            if at >= end and lead[at]:
                chosen.append((at, size, value))
                end = at + size
        if not chosen:
            return data, origin
        parts, origins, at = [], [], 0
        for place, size, value in chosen:
            fresh = np.frombuffer(self.map.replacement(value), dtype=np.uint8)
            parts += [data[at:place], fresh]
            origins += [origin[at:place], np.full(len(fresh), place)]
            at = place + size
        parts.append(data[at:])
        origins.append(origin[at:])
        return np.concatenate(parts), np.concatenate(origins)

    def text(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """One text's normalised bytes with the blank before it, and their source offsets with the end behind them."""
        whole, places = _valid(data)
        out, origin = self._replaced(np.frombuffer(whole, dtype=np.uint8))
        origin = np.append(origin, len(whole))
        if places is not None:
            origin = np.append(places, len(data))[origin]
        if self.squeeze and len(out):
            blank = out == SPACE
            keep = ~(blank & np.concatenate(([True], blank[:-1])))
            out, origin = out[keep], origin[np.append(keep, True)]
        # a space symbol in the text is a blank from here on
        a, b, c = self.symbol
        at = np.flatnonzero((out[:-2] == a) & (out[1:-1] == b) & (out[2:] == c)) if len(out) > 2 else ()
        if len(at):
            keep = np.ones(len(out), dtype=bool)
            keep[at + 1] = keep[at + 2] = False
            out = out.copy()
            out[at] = SPACE
            out, origin = out[keep], origin[np.append(keep, True)]
        if self.squeeze:
            used = np.flatnonzero(out != SPACE)
            last = int(used[-1]) + 1 if len(used) else 0
            out, origin = out[:last], origin[: last + 1]
        if not len(out):
            return out, origin[:1]
        return np.concatenate(([np.uint8(SPACE)], out)), np.concatenate((origin[:1], origin))

    def slice(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of texts that are each ended by a blank: bytes, where each text begins, each
        byte's offset in its own source text, and the source offset behind each text's last byte.
        """
        plain = not self.squeeze and not len(self.map.units)
        if plain:
            raw = data.tobytes()
            try:
                raw.decode()
                plain = SYMBOL.encode() not in raw
            except UnicodeDecodeError:
                plain = False
        if plain:
            # the blank that ends a text is the one before the next
            surface = np.concatenate(([np.uint8(SPACE)], data[:-1]))
            offset = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts)) - 1
            offset[starts[:-1]] = 0
            return surface, starts, offset, np.diff(starts) - 1
        parts = [self.text(data[a : b - 1].tobytes()) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        # an empty text keeps one blank, as above, so that every text has a byte
        surface = np.concatenate([s if len(s) else np.array([SPACE], np.uint8) for s, _ in parts])
        offset = np.concatenate([o[:-1] if len(s) else o[:1] for s, o in parts])
        begin = np.concatenate(([0], np.cumsum([max(len(s), 1) for s, _ in parts])))
        return surface, begin, offset, np.array([o[-1] for _, o in parts], dtype=np.int64)


@dataclass
class Pieces:
    """Ids of a slice's texts one after the other, how many each text has, and each id's source bytes [start, end)."""

    first: int
    ids: np.ndarray
    counts: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Strings:
    """A table of short byte strings, put together in the order of given numbers."""

    def __init__(self, values: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(values), dtype=np.uint8)
        self.size = np.array([len(v) for v in values], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def runs(self, numbers: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The strings of each run of numbers, end to end."""
        size = self.size[numbers]
        stop = np.cumsum(size)
        move = np.repeat(self.begin[numbers] - stop + size, size)
        move += np.arange(len(move))
        whole = self.flat[move].tobytes()
        ends = np.concatenate(([0], stop))[np.cumsum(counts)].tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]


class PieceEncoder:
    """Encodes text columns; one per worker process, see ``shared``."""

    _shared: dict[str, PieceEncoder] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        inner = [p.piece for p in proto.pieces if any(a != SYMBOL and b == SYMBOL for a, b in zip(p.piece, p.piece[1:]))]
        if inner or not spec.add_dummy_prefix or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this vocabulary's pieces are not bounded by blanks")
        if any(p.type == p.USER_DEFINED for p in proto.pieces) or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("user-defined symbols and denormalisation are not supported")
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.remove_extra_whitespaces)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        # chunks are normalised already and bring their blanks with them
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.chunks = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = [p.type for p in proto.pieces]
        self.is_byte = np.array([k == 6 for k in kinds])
        self.plain = np.array([k in (1, 5) for k in kinds])
        surface = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(SYMBOL, " ").encode() for p in proto.pieces]
        self.surface = Strings(surface)
        self.blank_first = np.array([s.startswith(b" ") for s in surface]) & self.plain
        self.decimal = Strings([b"%d," % i for i in range(len(kinds))])
        self._clear()

    @classmethod
    def shared(cls, path: str) -> PieceEncoder:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.known_bytes = 0
        self.begin = np.zeros(1 << 10, dtype=np.int64)
        self.count = np.zeros(1 << 10, dtype=np.int64)
        self.pool = np.zeros((3, 1 << 14), dtype=np.int32)  # id, start and end in the chunk
        self.used = 0

    def _room(self, chunks: int, pieces: int) -> None:
        while len(self.begin) < chunks:
            self.begin, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.count))
        while self.pool.shape[1] < pieces:
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)), axis=1)

    def _learn(self, chunks: list[str]) -> None:
        coded = self.chunks.encode(chunks, return_type=int, num_threads=1)
        count = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        ids = np.fromiter(itertools.chain.from_iterable(coded), dtype=np.int32, count=int(count.sum()))
        data = np.frombuffer("".join(chunks).encode(), dtype=np.uint8)
        end = np.cumsum(self.surface.size[ids])
        lost = not (self.plain[ids] | self.is_byte[ids]).all()
        if lost:
            # what an unknown id stands for is only known to the library
            protos = self.chunks.encode(chunks, return_type="proto", num_threads=1)
            end = np.cumsum([p.end - p.begin for proto in protos for p in proto.pieces])
        start = np.concatenate(([0], end[:-1])) if len(end) else end
        if not lost:
            # bytes of one character: the last one stands for it, the others for nothing
            at = np.flatnonzero(self.is_byte[ids])
            heads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            char = np.searchsorted(heads, start[at], side="right") - 1
            end[at] = np.where(end[at] == heads[char + 1], end[at], heads[char])
            start[at] = heads[char]
        size = np.fromiter((len(c.encode()) for c in chunks), dtype=np.int64, count=len(chunks))
        base = np.repeat(np.cumsum(size) - size, count)
        number = len(self.known)
        self._room(number + len(chunks), self.used + len(ids))
        self.known.update(zip(chunks, range(number, number + len(chunks))))
        self.known_bytes += int(size.sum())
        self.begin[number : number + len(chunks)] = self.used + np.cumsum(count) - count
        self.count[number : number + len(chunks)] = count
        self.pool[:, self.used : self.used + len(ids)] = ids, start - base, end - base
        self.used += len(ids)

    def _numbers(self, distinct: list[str]) -> np.ndarray:
        if len(self.known) > KEPT_CHUNKS or self.known_bytes > KEPT_BYTES:
            self._clear()
        numbers = list(map(self.known.get, distinct))
        fresh = [c for c, k in zip(distinct, numbers) if k is None]
        if fresh:
            self._learn(fresh)
            numbers = list(map(self.known.get, distinct))
        return np.array(numbers, dtype=np.int64)

    def _slice(self, first: int, data: np.ndarray, starts: np.ndarray) -> Pieces:
        surface, begin, offset, tail = self.normalizer.slice(data, starts)
        size = np.diff(begin)
        blank = surface == SPACE
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        opens[begin[:-1]] = True
        heads = np.flatnonzero(opens)
        text = np.searchsorted(begin, heads, side="right") - 1
        # Arrow finds the distinct chunks, comparing bytes
        bounds = np.append(heads, len(surface)).astype(np.int32 if len(surface) < 1 << 31 else np.int64)
        kind = pa.string() if bounds.dtype == np.int32 else pa.large_string()
        chunks = pa.Array.from_buffers(kind, len(heads), [None, pa.py_buffer(bounds), pa.py_buffer(surface)])
        used = np.flatnonzero(size[text] > 1)
        coded = chunks.take(pa.array(used)).dictionary_encode() if len(used) < len(heads) else chunks.dictionary_encode()
        number = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(coded.indices)]
        heads, text = heads[used], text[used]
        count = self.count[number]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(self.begin[number], count) + step
        base = np.repeat(heads, count)
        # a piece ends where the next byte's source begins
        owner = np.repeat(text, count)
        offset = np.append(offset, 0)
        low, high = base + self.pool[1, at], base + self.pool[2, at]
        start = offset[low]
        end = np.where(high < begin[owner + 1], offset[high], tail[owner])
        counts = np.bincount(text, weights=count, minlength=len(size)).astype(np.int64)
        return Pieces(first, self.pool[0, at], counts, start, end)

    def column(self, texts: pa.Array) -> Iterator[Pieces]:
        """Pieces of a text column, slice by slice; nulls are empty."""
        for first, data, starts in slices(texts, separator=" "):
            yield self._slice(first, data, starts)

    def decoded(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The library's text for each run of ids, in UTF-8.

        Ids of plain pieces and whole characters in bytes are looked up; any other run (control
        or unknown ids, broken characters, no blank first) goes to the library.
        """
        offsets = np.concatenate(([0], np.cumsum(counts)))
        joined = self.surface.runs(ids, counts)
        usual = self.plain[ids] | self.is_byte[ids]
        odd = np.bincount(np.repeat(np.arange(len(counts)), counts)[~usual], minlength=len(counts)) > 0
        filled = np.flatnonzero(counts)
        odd[filled] |= ~self.blank_first[ids[offsets[filled]]] | self.normalizer.squeeze
        out = []
        for k, whole in enumerate(joined):
            if not odd[k]:
                try:
                    whole.decode()
                    out.append(whole[1:])
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(self.library.decode(ids[offsets[k] : offsets[k + 1]].tolist()).encode())
        return out

    def digests(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """SHA-256 of each run's decimal ids, joined by commas."""
        return [hashlib.sha256(s[:-1]).hexdigest() for s in self.decimal.runs(ids, counts)]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode_pieces(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, starts, ends``: the ids of every text and the bytes of the text that each stands for."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(path)
        for batch in batches:
            for p in encoder.column(batch.column(1)):
                lists = [list_array(x, p.counts, pa.int32()) for x in (p.ids, p.start, p.end)]
                own = batch.column(0).slice(p.first, len(p.counts))
                yield pa.RecordBatch.from_arrays([own, *lists], names=["doc_id", "ids", "starts", "ends"])

    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_pieces(encoded: DataFrame, model: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` of lists of ids; a null list is empty."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(path)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type))
            counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            found = encoder.decoded(np.asarray(lists.flatten()), counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(doc_id).cast("long"), F.col(ids).cast("array<int>"))
    return rows.mapInArrow(run, "doc_id long, text string")


REPORT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, n_covered long"


def round_trip(docs: DataFrame, model: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every text's ids and of the text decoded from them, and how many of its bytes its pieces stand for."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(path)
        for batch in batches:
            length = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64)
            for p in encoder.column(batch.column(1)):
                n = len(p.counts)
                decoded = [hashlib.sha256(t).hexdigest() for t in encoder.decoded(p.ids, p.counts)]
                ahead = np.concatenate(([0], np.cumsum(p.end - p.start)))
                stop = np.cumsum(p.counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(p.first, n),
                        pa.array(p.counts),
                        pa.array(encoder.digests(p.ids, p.counts), pa.string()),
                        pa.array(decoded, pa.string()),
                        pa.array(length[p.first : p.first + n]),
                        pa.array(ahead[stop] - ahead[stop - p.counts]),
                    ],
                    names=[f.split()[0] for f in REPORT.split(", ")],
                )

    return _rows(docs, doc_id, text).mapInArrow(run, REPORT)
