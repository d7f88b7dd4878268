"""SentencePiece models (BPE with byte fallback): normalising with alignment, encoding, decoding."""

from __future__ import annotations

import functools
import re
import struct
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from floodplain.llm.merges import MergeTable, merge_queued, merge_ranked
from floodplain.llm.shared import list_array, map_texts, ragged

SPACE = "▁"
# Sequences up to this long are merged together in arrays, longer ones by a queue.
ARRAY_SYMBOLS = 96
# Distinct pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 250_000

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def read_model(path: str) -> bytes:
    """A model file's bytes, to be sent to the tasks: vocabularies are a few hundred kB; 64 MB is refused."""
    with open(path, "rb") as file:
        data = file.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} holds {len(data)} bytes; a tokenizer model of at most 64 MB is sent to the tasks")
    return data


def numbering() -> defaultdict[str, int]:
    """Gives each key that is asked for the first time the next number."""
    return defaultdict(count().__next__)


class CharMap:
    """A compiled character map: the longest key that starts at a place is replaced.

    The map is a little-endian length, a double-array trie over UTF-8 bytes and
    a block of replacements that end in a zero byte. Decoded once into a dict;
    keys are found through the set of characters that can begin one.
    """

    def __init__(self, compiled: bytes):
        self.rules: dict[str, str] = {}
        if compiled:
            size = struct.unpack("<I", compiled[:4])[0]
            units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
            texts = compiled[4 + size :]
            self._walk(units, texts)
        self.longest = max(map(len, self.rules), default=0)
        begins = {key[0] for key in self.rules}
        self._begin = re.compile("[" + "".join(map(re.escape, sorted(begins))) + "]") if begins else None

    def _walk(self, units: list[int], texts: bytes) -> None:
        def offset(unit: int) -> int:
            return (unit >> 10) << ((unit & (1 << 9)) >> 6)

        stack = [(offset(units[0]), b"")]
        while stack:
            node, key = stack.pop()
            for byte in range(1, 256):
                at = node ^ byte
                if at >= len(units) or units[at] & 0x800000FF != byte:
                    continue
                unit, longer = units[at], key + bytes([byte])
                below = at ^ offset(unit)
                if unit >> 8 & 1:
                    value = units[below] & 0x7FFFFFFF
                    self.rules[longer.decode("utf-8", "surrogateescape")] = texts[value : texts.index(b"\0", value)].decode("utf-8")
                stack.append((below, longer))

    def replace(self, text: str) -> list[tuple[str, int, int]]:
        """``(replacement, begin, end)`` of every place that changes, in order of the source characters."""
        found, at = [], 0
        while self._begin and (hit := self._begin.search(text, at)):
            at = hit.start()
            for size in range(min(self.longest, len(text) - at), 0, -1):
                new = self.rules.get(text[at : at + size])
                if new is not None:
                    found.append((new, at, at + size))
                    at += size
                    break
            else:
                at += 1
        return found


class Model:
    """A parsed model. ``encode`` and ``decode`` work on many texts at once."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are read")
        if proto.trainer_spec.treat_whitespace_as_suffix or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("white space must be escaped and stand before words")
        spec = proto.normalizer_spec
        self.dummy_prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.charmap = CharMap(spec.precompiled_charsmap)
        self.text = [piece.piece for piece in proto.pieces]
        self.kind = np.array([piece.type for piece in proto.pieces], np.int8)
        self.unknown = int(np.flatnonzero(self.kind == UNKNOWN)[0])
        pieces = {text: i for i, text in enumerate(self.text) if self.kind[i] == NORMAL}
        if any(SPACE in text.lstrip(SPACE) for text in pieces):
            raise ValueError("a piece reaches over the beginning of a word")
        scores = np.array([piece.score for piece in proto.pieces])
        self.table = MergeTable(pieces, np.unique(-scores, return_inverse=True)[1].astype(np.int32))
        self.char_id = np.full(0x110000, -1, np.int32)
        for text, i in pieces.items():
            if len(text) == 1:
                self.char_id[ord(text)] = i
        self.byte_id = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.kind == BYTE):
            self.byte_id[int(self.text[i][3:5], 16)] = i
        surface = [text.replace(SPACE, " ").encode() if kind == NORMAL else b"" for text, kind in zip(self.text, self.kind, strict=True)]
        for value in range(256):
            surface[self.byte_id[value]] = bytes([value])
        surface[self.unknown] = proto.trainer_spec.unk_surface.encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(text) for text in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        # A line break that no piece holds ends a pre-token, as a space before a word does.
        broken = "" if any("\n" in text for text in pieces) else "\n"
        self.pretoken = re.compile(f"{SPACE}*[^{SPACE}{broken}]+|{SPACE}+" + (f"|{broken}" if broken else ""))
        self.forget()

    # -- normalising ------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text, and where each of its characters begins and ends in the source's bytes.

        Characters that a replacement made all carry the bytes of what was replaced;
        the space put before the text carries none.
        """
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        wide = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        end = np.cumsum(wide)
        begin = end - wide
        changes = self.charmap.replace(text)
        if changes:
            parts, begins, ends, at = [], [], [], 0
            for new, a, b in changes:
                parts += [text[at:a], new]
                begins += [begin[at:a], np.full(len(new), begin[a])]
                ends += [end[at:a], np.full(len(new), end[b - 1])]
                at = b
            text = "".join([*parts, text[at:]])
            begin, end = np.concatenate([*begins, begin[at:]]), np.concatenate([*ends, end[at:]])
        if self.squeeze:
            kept = [i for i, c in enumerate(text) if c != " " or (i and text[i - 1] != " ")]
            while kept and text[kept[-1]] == " ":
                kept.pop()
            text, begin, end = "".join(text[i] for i in kept), begin[kept], end[kept]
        if not text:
            return "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = text.replace(" ", SPACE)
        if self.dummy_prefix:
            text, begin, end = SPACE + text, np.r_[begin[:1], begin], np.r_[begin[:1], end]
        return text, begin, end

    def escape(self, text: str) -> str:
        """The normalised text alone, for models that change nothing else."""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE) if text else ""

    def pretokens(self, text: str) -> list[str]:
        """Parts of a normalised text over whose borders nothing merges."""
        return self.pretoken.findall(text)

    # -- merging ----------------------------------------------------------------

    def forget(self) -> None:
        self.index = numbering()
        self._ids, self._chars = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self._starts, self._sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points, symbols (below 0: no piece) and lengths of ``words``."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return codes, self.char_id[codes], np.fromiter(map(len, words), np.int64, len(words))

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Surviving symbols of each word, their first characters (over all words) and their numbers."""
        codes, symbols, sizes = self.symbols(words)
        short = sizes <= ARRAY_SYMBOLS
        if short.all():
            return merge_ranked(self.table, symbols, sizes)
        places = np.cumsum(sizes) - sizes
        in_short = np.repeat(short, sizes)
        sym, first, counts = merge_ranked(self.table, symbols[in_short], sizes[short])
        parts = [(sym, np.flatnonzero(in_short)[first])]
        number = np.zeros(len(words), np.int64)
        number[short] = counts
        for w in np.flatnonzero(~short):
            sym, kept = merge_queued(self.table, symbols[places[w] : places[w] + sizes[w]].tolist())
            parts.append((np.array(sym, np.int32), np.array(kept, np.int64) + places[w]))
            number[w] = len(sym)
        sym, first = (np.concatenate(part) for part in zip(*parts, strict=True))
        order = np.argsort(first, kind="stable")
        return sym[order], first[order], number

    def _learn(self, words: list[str]) -> None:
        """Encode words not met before and remember their pieces and how many characters each covers."""
        sym, first, number = self.merged(words)
        total = sum(map(len, words))
        covers = np.diff(np.r_[first, total]).astype(np.int32)
        self._starts = np.r_[self._starts, len(self._ids) + np.cumsum(number) - number]
        self._sizes = np.r_[self._sizes, number]
        self._ids, self._chars = np.r_[self._ids, sym], np.r_[self._chars, covers]

    def lookup(self, words: list[str]) -> np.ndarray:
        """Each word's number in the memory, after learning the new ones."""
        if len(self.index) > REMEMBERED:
            self.forget()
        index, before = self.index, len(self.index)
        numbers = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        if len(index) > before:
            self._learn(list(islice(index, before, None)))
        return numbers

    # -- encoding ---------------------------------------------------------------

    def encode(self, texts: list[str]) -> dict[str, np.ndarray]:
        """``ids`` of all texts in one array with each one's ``begin`` and ``end`` in source bytes; ``sizes`` per text.

        A character without a piece becomes its bytes, each of which covers its
        own byte where normalising has left the character as it was.
        """
        words: list[str] = []
        per_text, begins, ends, codes = [], [], [], []
        for text in texts:
            normal, begin, end = self.normalise(text)
            mine = self.pretokens(normal)
            words += mine
            per_text.append(len(mine))
            begins.append(begin)
            ends.append(end)
            codes.append(normal)
        begin, end = (np.concatenate([np.zeros(0, np.int64), *part]) for part in (begins, ends))
        code = np.frombuffer("".join(codes).encode("utf-32-le"), np.uint32)
        numbers = self.lookup(words)
        sizes = self._sizes[numbers]
        gather = ragged(self._starts[numbers], sizes)
        ids, covers = self._ids[gather], self._chars[gather].astype(np.int64)
        last = np.cumsum(covers)
        first = last - covers
        begin, end = begin[first], end[last - 1] if len(last) else end[:0]
        word_of = np.repeat(np.arange(len(numbers)), sizes)
        text_of = np.repeat(np.arange(len(texts)), per_text)[word_of] if len(words) else np.zeros(0, np.int64)
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            raw = [chr(c).encode() for c in code[first[lost]].tolist()]
            repeat = np.ones(len(ids), np.int64)
            repeat[lost] = [len(r) for r in raw]
            at = np.repeat(np.arange(len(ids)), repeat)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            whole = (end - begin == repeat)[at]
            broken = np.repeat(ids < 0, repeat)
            begin_at = np.where(broken & whole, begin[at] + inner, begin[at])
            end = np.where(broken & whole, begin_at + 1, end[at])
            ids, begin, text_of = ids[at], begin_at, text_of[at]
            ids[broken] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return {"ids": ids, "begin": begin.astype(np.int32), "end": end.astype(np.int32), "sizes": np.bincount(text_of, minlength=len(texts)).astype(np.int64)}

    # -- decoding ---------------------------------------------------------------

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of ``ids``: control pieces vanish, bytes are joined, and one space before a text goes."""
        ids = np.asarray(ids, np.int64)
        spread = self.surface_size[ids]
        raw = self.surface[ragged(self.surface_start[ids], spread)].tobytes()
        ends = np.r_[0, np.cumsum(spread)][np.cumsum(sizes)] if len(sizes) else np.zeros(0, np.int64)
        texts, at, place = [], 0, 0
        for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
            mine = ids[place : place + size]
            control = int((self.kind[mine] == CONTROL).sum())
            try:
                text = self._broken(mine.tolist()) if control else raw[at:end].decode()
            except UnicodeDecodeError:
                text = self._broken(mine.tolist())
            if self.dummy_prefix or self.squeeze:
                opening = next((i for i in mine[: 1 + control].tolist() if self.kind[i] != CONTROL), None)
                if opening is not None and self.text[opening].startswith(SPACE):
                    text = text[1:]
            texts.append(text)
            at, place = end, place + size
        return texts

    def _broken(self, ids: list[int]) -> str:
        """Decode where bytes do not make characters: each byte that fits nowhere becomes one replacement character."""
        parts, held = [], b""
        for i in [*ids, None]:
            if i is not None and self.kind[i] == BYTE:
                held += bytes([int(self.text[i][3:5], 16)])
                continue
            while held:
                for size in range(1, min(4, len(held)) + 1):
                    try:
                        parts.append(held[:size].decode())
                        held = held[size:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    parts.append("�")
                    held = held[1:]
            if i is not None:
                start = int(self.surface_start[i])
                parts.append(self.surface[start : start + int(self.surface_size[i])].tobytes().decode())
        return "".join(parts)


@functools.lru_cache(maxsize=2)
def model_of(data: bytes) -> Model:
    """Parsed once per worker."""
    return Model(data)


ENCODED = {
    "ids": T.ArrayType(T.IntegerType(), False), "begins": T.ArrayType(T.IntegerType(), False),
    "ends": T.ArrayType(T.IntegerType(), False), "decoded": T.StringType(),
}


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of whole texts with the source bytes of every piece, and the text decoded from the ids.

    ``(id, ids, begins, ends, decoded)``, one row per row. Texts are normalised by
    the model's character map, longest key first, with the source bytes of every
    character kept, so that each piece projects onto bytes of the original text.
    Null and empty texts give no pieces and an empty text; repeated rows repeat;
    an empty table gives an empty one; other columns, whatever their names, are
    not read. Partitions are worked on where they lie: nothing is shuffled.
    """
    data = read_model(model)

    def work(texts: list[str]) -> dict[str, pa.Array]:
        known = model_of(data)
        made = known.encode(texts)
        return {
            "ids": list_array(made["ids"].astype(np.int32), made["sizes"]),
            "begins": list_array(made["begin"], made["sizes"]),
            "ends": list_array(made["end"], made["sizes"]),
            "decoded": pa.array(known.decode(made["ids"], made["sizes"]), pa.string()),
        }

    return map_texts(docs, id_col, text_col, ENCODED, work)
