"""Operator 2: SentencePiece encoding that keeps byte offsets into the original text, and decoding.

A text is normalised by taking, at each place, the longest prefix known to the model's compiled character map; the
source offset of every normalised byte is recorded. Byte-pair merging then runs on the normalised text, and each
piece's borders are projected through the record to the bytes of the original text.

Results for odd input: a missing text counts as empty; an empty text has no piece but the end id; a malformed byte
counts as U+FFFD; repeated rows give repeated results; an empty table gives an empty table. Only the columns named in
`keep` pass, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.llm.common import per_batch, slices

SPACE = "▁"
_SPACE = SPACE.encode()
_BROKEN = "�".encode()
_NEVER = float("-inf")

# Merged words kept by a worker; the memory is emptied when full, so it never grows with the corpus.
WORDS_KEPT = 400_000
LONGEST_KEPT = 48

# Bytes of text whose new words are merged together, and the fewest words that are.
TEXTS_AT_ONCE = 1 << 20
FEWEST_AT_ONCE = 64


class CharacterMap:
    """A double-array trie from byte strings to their replacements, as a model file stores it."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self._units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self._texts = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self._units)

    def longest(self, data: bytes, start: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix at this place, and that prefix's length."""
        units, found = self._units, None
        at = self._step(units[0])
        for index in range(start, len(data)):
            at ^= data[index]
            unit = units[at] if at < len(units) else 0
            if unit & 0x800000FF != data[index]:
                break
            at ^= self._step(unit)
            if unit >> 8 & 1:
                text = units[at] & 0x7FFFFFFF
                found = self._texts[text : self._texts.index(b"\0", text)], index + 1 - start
        return found

    @staticmethod
    def _step(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Normalizer:
    """Normalised bytes of a text, and for each of them the offset in the text that it comes from."""

    def __init__(self, spec, symbols: list[bytes] = (), suffix: bool = False) -> None:
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix and not suffix
        self.suffix = spec.add_dummy_prefix and suffix
        self.trim = spec.remove_extra_whitespaces
        self.space = _SPACE if spec.escape_whitespaces else b" "
        self.symbols = re.compile(b"|".join(map(re.escape, sorted(symbols, key=len, reverse=True)))) if symbols else None
        self.plain = not (self.map or self.trim or self.suffix or self.symbols)

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The offsets have one entry more: the end of what was used of the text."""
        if not data:
            return b"", np.zeros(1, np.int32)
        return self._plain(data) if self.plain and _well_formed(data) else self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        source = np.frombuffer(data, np.uint8)
        widths = np.where(source == 0x20, len(self.space), 1)
        offsets = np.repeat(np.arange(len(data), dtype=np.int32), widths)
        head = self.space if self.prefix else b""
        ends = np.zeros(len(head), np.int32), offsets, np.array([len(data)], np.int32)
        return head + data.replace(b" ", self.space), np.concatenate(ends)

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        out, offsets, at, after_space = bytearray(), [], 0, self.trim
        while self.trim and at < len(data):
            text, used = self._chunk(data, at)
            if text != b" ":
                break
            at += used
        if at == len(data):
            return b"", np.array([at], np.int32)

        def put(text: bytes, place: int) -> None:
            out.extend(text)
            offsets.extend([place] * len(text))

        if self.prefix:
            put(self.space, at)
        while at < len(data):
            text, used = self._chunk(data, at)
            if after_space:
                text = text.lstrip(b" ")
            if text:
                put(text.replace(b" ", self.space), at)
                after_space = self.trim and text.endswith(b" ")
            at += used
        if self.trim:
            while out.endswith(self.space):
                at = offsets[len(out) - len(self.space)]
                del out[-len(self.space) :], offsets[-len(self.space) :]
        if self.suffix:
            put(self.space, at)
        return bytes(out), np.array([*offsets, at], np.int32)

    def _chunk(self, data: bytes, at: int) -> tuple[bytes, int]:
        if self.symbols and (symbol := self.symbols.match(data, at)):
            return symbol[0], len(symbol[0])
        if self.map and (found := self.map.longest(data, at)):
            return found
        width = _width(data, at)
        return (data[at : at + width], width) if width else (_BROKEN, 1)


def _width(data: bytes, at: int) -> int:
    """Bytes of the character at this place; 0 if malformed."""
    lead = data[at]
    width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    return width if _well_formed(data[at : at + width]) else 0


def _well_formed(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


class Merger:
    """Merges many words side by side: symbols are numbers, and pairs of them that make a piece are a sorted table."""

    def __init__(self, score: dict[str, float]) -> None:
        number = {text: at for at, text in enumerate(dict.fromkeys([*score, *(char for text in score for char in text)]))}
        self.texts = list(number)
        # One symbol more stands for all characters that no piece has.
        self._base = len(number) + 1
        self._chars = np.full(0x110000, len(number), np.int32)
        for text, at in number.items():
            if len(text) == 1:
                self._chars[ord(text)] = at
        pairs = {}
        for text, value in score.items():
            for cut in range(1, len(text)):
                left, right = number.get(text[:cut]), number.get(text[cut:])
                if left is not None and right is not None:
                    pairs[left * self._base + right] = value, number[text]
        keys = sorted(pairs)
        # The last entry is found for pairs that make no piece.
        self._keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self._scores = np.array([*(pairs[key][0] for key in keys), _NEVER])
        self._merged = np.array([*(pairs[key][1] for key in keys), -1], np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * np.int64(self._base) + right
        at = np.searchsorted(self._keys, keys)
        return np.where(self._keys[at] == keys, at, len(self._keys) - 1)

    def __call__(self, words: list[str]):
        """Yields words' places, their numbers of symbols and these symbols, for the words that no round joins further.

        A round joins the neighbours with the best score in each word, the leftmost of equals.
        """
        never = len(self._keys) - 1
        word, sizes = np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words))
        symbols = self._chars[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(sizes) - sizes
        pairs = np.append(self._pairs(symbols[:-1], symbols[1:]), never)
        pairs[starts + sizes - 1] = never
        scores = self._scores[pairs]
        while len(word):
            best = np.maximum.reduceat(scores, starts)
            if (done := best == _NEVER).any():
                inside = np.repeat(done, sizes)
                yield word[done], sizes[done], symbols[inside]
                symbols, pairs, scores = symbols[~inside], pairs[~inside], scores[~inside]
                word, sizes, best = word[~done], sizes[~done], best[~done]
                starts = np.cumsum(sizes) - sizes
                if not len(word):
                    return
            equal = np.flatnonzero(scores == np.repeat(best, sizes))
            at = equal[np.searchsorted(equal, starts)]
            symbols[at] = self._merged[pairs[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, pairs, scores = symbols[stays], pairs[stays], scores[stays]
            earlier = np.arange(len(word))
            at, starts, sizes = at - earlier, starts - earlier, sizes - 1
            pairs[at], scores[at] = never, _NEVER
            for near in (at[at < starts + sizes - 1], at[at > starts] - 1):
                pairs[near] = found = self._pairs(symbols[near], symbols[near + 1])
                scores[near] = self._scores[found]


class Encoder:
    """Byte-pair encoding with a model file. `end` adds the end id, which stands at the end of the text."""

    def __init__(self, path: str, end: bool = True) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.decoder = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("only byte-pair models are supported")
        if any(piece.type == kinds.UNUSED for piece in proto.pieces):
            raise ValueError("models with unused pieces are not supported")
        named = list(enumerate(proto.pieces))
        merged = {piece.piece: (piece.score, at) for at, piece in named if piece.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self._score = {text: score for text, (score, _) in merged.items()}
        # The library looks up control and unknown pieces by name before ordinary ones.
        self._id = {text: at for text, (_, at) in merged.items()}
        self._id |= {piece.piece: at for at, piece in named if piece.type not in (kinds.NORMAL, kinds.USER_DEFINED)}
        self._unknown = self.decoder.unk_id()
        fallback = proto.trainer_spec.byte_fallback
        self._byte = [self._id[f"<0x{byte:02X}>"] for byte in range(256)] if fallback else None
        self._end = self.decoder.eos_id() if end else None
        symbols = [piece.piece for _, piece in named if piece.type == kinds.USER_DEFINED]
        self.normalize = Normalizer(
            proto.normalizer_spec, [text.encode() for text in symbols], proto.trainer_spec.treat_whitespace_as_suffix
        )
        self._symbols = frozenset(symbols)
        self._words = _splitter(self._score, symbols)
        self._kept: dict[str, bytes] = {}
        self._merger = Merger(self._score)
        texts = self._merger.texts
        self._token = np.array([*(self._id.get(text, self._unknown) for text in texts), self._unknown], np.int32)
        self._width = np.array([*(len(text.encode()) for text in texts), 0], np.int32)

    def encode(self, data: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first byte and the byte after the last of each piece in the original text.

        Pieces of single bytes that make up one character are empty but for the last, which has the character.
        """
        return self.encode_all([data])[0]

    def encode_all(self, texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for each text; words that are not in memory are merged together."""
        parts, new = [], {}
        for data in texts:
            normal, offsets = self.normalize(data or b"")
            words = self._words(normal.decode())
            found, gaps, at = list(map(self._kept.get, words)), [], -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                gaps.append((at, words[at]))
                new[words[at]] = b""
            parts.append((data, offsets, found, gaps))
        new = self._encode_words(list(new))
        for _, _, found, gaps in parts:
            for at, word in gaps:
                found[at] = new[word]
        kept = {word: pieces for word, pieces in new.items() if len(word) <= LONGEST_KEPT}
        if len(self._kept) + len(kept) > WORDS_KEPT:
            self._kept.clear()
        self._kept.update(kept)
        return [self._borders(data, offsets, found) for data, offsets, found, _ in parts]

    def _borders(self, data: bytes | None, offsets: np.ndarray, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs = np.frombuffer(b"".join(found), np.int32).reshape(-1, 2)
        tokens, widths = pairs[:, 0], pairs[:, 1]
        ends = np.cumsum(widths, dtype=np.int64)
        starts = ends - widths
        if self._byte is None:
            tokens, starts, ends = self._join_unknown(tokens, starts, ends)
        starts, ends = offsets[starts], offsets[ends]
        if self._end is None:
            return tokens, starts, ends
        last = np.int32(len(data or b""))
        return np.append(tokens, np.int32(self._end)), np.append(starts, last), np.append(ends, last)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.decoder.decode(ids, num_threads=1) if ids else []

    def _join_unknown(self, tokens, starts, ends):
        """Unknown characters side by side are one piece."""
        unknown = tokens == self._unknown
        first = np.ones(len(tokens), bool)
        first[1:] = ~(unknown[1:] & unknown[:-1])
        last = np.append(first[1:], True) if len(tokens) else first
        return tokens[first], starts[first], ends[last]

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Each word's pairs of id and bytes; long words, symbols and words with unknown characters go one by one."""
        found = {}
        short = [word for word in words if len(word) <= LONGEST_KEPT and word not in self._symbols]
        for places, sizes, symbols in self._merger(short) if len(short) >= FEWEST_AT_ONCE else ():
            tokens, ends = self._token[symbols], np.cumsum(sizes)
            pairs = np.column_stack([tokens, self._width[symbols]]).tobytes()
            known = np.add.reduceat(tokens == self._unknown, ends - sizes, dtype=np.int64) == 0
            for place, start, end in zip(*(each[known].tolist() for each in (places, (ends - sizes) * 8, ends * 8))):
                found[short[place]] = pairs[start:end]
        return found | {word: self._encode_word(word) for word in words if word not in found}

    def _encode_word(self, word: str) -> bytes:
        """Pairs of id and bytes of normalised text."""
        pairs = []
        for piece in [word] if word in self._symbols else self._merge(word):
            at = self._id.get(piece, self._unknown)
            data = piece.encode()
            if at == self._unknown and self._byte is not None:
                for byte in data:
                    pairs += (self._byte[byte], 0)
                pairs[-1] = len(data)
            else:
                pairs += (at, len(data))
        return array("i", pairs).tobytes()

    def _merge(self, word: str) -> list[str]:
        """Join the neighbours with the best score, the leftmost of equals, until none is a piece."""
        parts, score = list(word), self._score
        if len(parts) > 64:
            return self._merge_long(parts)
        joined = [score.get(left + right, _NEVER) for left, right in zip(parts, parts[1:])]
        while joined and (best := max(joined)) != _NEVER:
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at < len(joined):
                joined[at] = score.get(parts[at] + parts[at + 1], _NEVER)
            if at:
                joined[at - 1] = score.get(parts[at - 1] + parts[at], _NEVER)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same by a heap and a linked list."""
        score, heap = self._score, []
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))

        def offer(left: int, right: int) -> None:
            text = parts[left] + parts[right]
            if (value := score.get(text)) is not None:
                heapq.heappush(heap, (-value, left, right, text))

        for index in range(len(parts) - 1):
            offer(index, index + 1)
        while heap:
            _, left, right, text = heapq.heappop(heap)
            if not parts[left] or not parts[right] or parts[left] + parts[right] != text or after[left] != right:
                continue
            parts[left], parts[right] = text, ""
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [part for part in parts if part]


def _splitter(score: dict[str, float], symbols: list[str]):
    """Cuts a normalised text where no piece of the model can span, so that words can be merged one by one."""
    inner = any(SPACE in piece.lstrip(SPACE) for piece in score)
    lines = not any("\n" in piece for piece in score if len(piece) > 1)
    if inner:
        pattern = "[^\\n]+|\\n" if lines else "(?s:.+)"
    else:
        pattern = f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n" if lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+"
    find = re.compile(pattern).findall
    if not symbols:
        return find
    cut = re.compile("(" + "|".join(map(re.escape, sorted(symbols, key=len, reverse=True))) + ")")
    return lambda text: [
        word for at, part in enumerate(cut.split(text)) if part for word in ([part] if at % 2 else find(part))
    ]


@lru_cache(maxsize=2)
def encoder(path: str, end: bool) -> Encoder:
    """One per worker process and model."""
    return Encoder(path, end)


_encoder = encoder


def encode(documents: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), end: bool = True) -> DataFrame:
    """Per row the columns of `keep`, `ids`, `starts`, `ends` (bytes of the original text) and `decoded`.

    `model` is a file that every executor can open at that path. One narrow pass; nothing is shuffled.
    """
    rows = documents.select(*[F.col(name) for name in keep], F.col(text).cast("binary").alias("__text"))
    lists = "ids array<int>, starts array<int>, ends array<int>, decoded string"
    kept = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in rows.schema.fields[:-1])

    def run(batch: pa.RecordBatch):
        coder = encoder(model, end)
        texts = batch.column("__text").to_pylist()
        for start, stop in slices(texts, TEXTS_AT_ONCE):
            found = coder.encode_all(texts[start:stop])
            borders = np.cumsum([0, *[len(ids) for ids, _, _ in found]], dtype=np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(borders), pa.array(np.concatenate(parts).astype(np.int32)))
                for parts in zip(*found)
            ]
            decoded = pa.array(coder.decode([ids.tolist() for ids, _, _ in found]), pa.string())
            part = batch.slice(start, stop - start)
            columns = [*part.columns[:-1], *lists, decoded]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "ids", "starts", "ends", "decoded"])

    return per_batch(rows, ", ".join(filter(None, [kept, lists])), run)


def digests(encoded: DataFrame) -> DataFrame:
    """Count and hash of the ids, and hash of the decoded text, per document."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
