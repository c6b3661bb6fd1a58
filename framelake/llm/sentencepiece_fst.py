"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into transducers:

* normaliser: the character map (a trie that writes upon its longest match) and, for spaces, a
  subsequential transducer (``Fst``): arcs by state and symbol, an arc for all other symbols, final outputs;
* pieces: an arc per piece, weighted; all arcs into each place come from a trie with failure arcs
  (Aho-Corasick), which reads a text once;
* byte fallback: an arc per character that no piece covers, writing its bytes' pieces (or, in models
  without byte pieces, the unknown piece once for a run of such characters).

Encoding composes the text with the normaliser, its output with pieces and fallback, and takes the path of
least weight in the tropical semiring (weights add up along a path, the least one wins, infinity is no arc),
relaxing all arcs into each place from left to right.

Weights: in unigram models an arc costs its piece's negative score.  In byte-pair models scores are ranks
of merges, and no weights of single pieces give what merging gives.  There the state is the last piece: an
arc costs its rank after a piece that it is compatible with, and infinity after any other.  Compatible are
two pieces if merging their text alone gives these two.  Merges inside neighbours do not touch, so a
path is finite exactly if it is the result of merging, and each prefix of a text has one such path: the
first finite arc into a place is the only one.
User-defined pieces: in unigram models arcs of the library's bonus, in byte-pair models always taken
where they match, longest first, and never merged.

Texts are cut where no piece can cross (between two characters that no piece has side by side, and so
before spaces) and parts are remembered, up to ``memory`` of them.

Results: null and empty texts have no pieces and decode to the empty text.  Decoding is exact for
models without a character map, but for texts that hold U+2581, which such models write for spaces (where
a model makes runs of spaces one, that sign's runs at a text's ends are kept, unlike the library's).  Texts of any
length are encoded whole; repeated rows are each encoded; empty tables give no rows; columns of ``docs``
with the name of a result column are replaced, others pass.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from framelake.llm.textops import on_other_work, ragged

SPACE = "▁"
# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
USER_DEFINED_COST = 0.1
INFINITY = float("inf")

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: numbers, floats as 4 bytes, or bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    pieces: list[tuple[str, float, int]]  # text, score, type
    kind: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool
    escape: bool

    @property
    def defined(self) -> re.Pattern | None:
        """User-defined pieces, longest first."""
        own = sorted((t for t, _, kind in self.pieces if kind == USER_DEFINED), key=lambda t: (-len(t.encode()), t))
        return re.compile("(" + "|".join(map(re.escape, own)) + ")") if own else None

    @staticmethod
    def parse(data: bytes) -> Model:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind} is neither unigram nor byte-pair")
        return Model(pieces, kind, normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)))


@dataclass(frozen=True)
class Fst:
    """A subsequential transducer over characters, starting in state 0."""

    arcs: dict[int, dict[str, tuple[int, str]]]  # state, symbol: next state, output
    others: dict[int, tuple[int, str]]  # state: next state for all other symbols, output before the symbol itself

    def __post_init__(self) -> None:
        # where other symbols are copied in place, the way to the next arc of another kind is one step
        loops = {q for q, (to, before) in self.others.items() if to == q and not before}
        leave = {q: [c for c, (to, _) in self.arcs[q].items() if to != q] for q in loops}
        object.__setattr__(self, "exits", {q: re.compile("|".join(map(re.escape, c)) or r"(?!)") for q, c in leave.items()})
        object.__setattr__(self, "copies", {q: {c: o for c, (to, o) in self.arcs[q].items() if to == q} for q in loops})
        if any(c in o for copies in self.copies.values() for c in copies for d, o in copies.items() if c != d):
            raise ValueError("an output that stays in place holds a symbol that another arc reads")

    def compose(self, text: str) -> str:
        """The output of the text's path."""
        out, at, state = [], 0, 0
        while at < len(text):
            if state in self.exits:
                found = self.exits[state].search(text, at)
                end = found.start() if found else len(text)
                run = text[at:end]
                for symbol, written in self.copies[state].items():
                    run = run.replace(symbol, written)
                out.append(run)
                at = end
                if not found:
                    break
            symbol = text[at]
            hit = self.arcs[state].get(symbol)
            if hit is None:
                to, before = self.others[state]
                hit = to, before + symbol
            state = hit[0]
            out.append(hit[1])
            at += 1
        return "".join(out)


def spaces(prefix: bool, squeeze: bool, escape: bool) -> Fst:
    """Spaces of a text: one written before it, runs made one and ends trimmed, all written as SPACE."""
    mark = SPACE if escape else " "
    lead = mark if prefix else ""
    start, word, gap = 0, 1, 2
    if not squeeze:
        return Fst({start: {" ": (word, lead + mark)}, word: {" ": (word, mark)}}, {start: (word, lead), word: (word, "")})
    return Fst({start: {" ": (start, "")}, word: {" ": (gap, "")}, gap: {" ": (gap, "")}}, {start: (word, lead), word: (word, ""), gap: (word, mark)})


class Normaliser:
    """Character map, then spaces."""

    def __init__(self, model: Model) -> None:
        self.model = model
        blob = model.charsmap
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""
        self.kept = model.defined
        self.spaces = spaces(model.dummy_prefix, model.squeeze, model.escape)

    def _longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest key at ``at`` in the double-array trie, and what it becomes."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = i + 1, self.texts[start : self.texts.index(b"\0", start)]
        return found

    def _mapped(self, text: str) -> str:
        pieces = self.kept.split(text) if self.kept else [text]  # user-defined ones, every second, stay as they are
        return "".join(p if i % 2 else self._characters(p.encode("utf-8", "surrogatepass")) for i, p in enumerate(pieces))

    def _characters(self, data: bytes) -> str:
        out, at = bytearray(), 0
        while at < len(data):
            hit = self._longest(data, at)
            if hit is None:
                end = at + 1
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
                hit = end, data[at:end]
            out += hit[1]
            at = hit[0]
        return out.decode("utf-8", "replace")

    def __call__(self, text: str) -> str:
        return self.spaces.compose(self._mapped(text) if self.units else text)

    def back(self, text: str) -> str:
        """Of pieces' text: spaces as they were."""
        text = text.replace(SPACE, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


class Transducer:
    def __init__(self, model: Model, memory: int = 600_000) -> None:
        """``memory``: how many parts and how many pairs of pieces are remembered."""
        self.model, self.normalise, self.memory = model, Normaliser(model), memory
        self.texts = [p[0] for p in model.pieces]
        self.ids = {t: i for i, (t, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.cost = [-score for _, score, _ in model.pieces]
        costs = [self.cost[i] for i in self.ids.values()]
        self.unknown_cost = max(costs, default=0.0) + UNKNOWN_PENALTY
        own = {t: i for i, (t, _, kind) in enumerate(model.pieces) if kind == USER_DEFINED}
        self.defined = model.defined if model.kind == BPE else None
        self.own = own
        if model.kind == UNIGRAM:
            for t, i in own.items():
                self.cost[i] = USER_DEFINED_COST + min(costs + [0.0]) * len(t.encode())  # below any other's that is not negative
            self.ids |= own
        self.unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
        self.bytes = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(model.pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.fallback = len(self.bytes) == 256
        self.written = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if kind in (CONTROL, UNUSED) else " ⁇ ".encode() if kind == UNKNOWN else t.encode() for i, (t, _, kind) in enumerate(model.pieces)]
        self.arcs = ahocorasick.Automaton()
        beside: set[str] = set()
        for t, i in self.ids.items():
            self.arcs.add_word(t, (len(t), i))
            beside.update(t[k : k + 2] for k in range(len(t) - 1))
        self.arcs.make_automaton()
        self.alone = {t for t in self.ids if len(t) == 1}
        self.beside = beside
        self.edges: dict[tuple[int, bool], list[tuple[float, str]]] = {}
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, float] = {}
        self.many = len(model.pieces)
        self.cut = self._cutter()
        # no piece has a space behind anything but spaces: then words stand alone, each with the one space before it
        self.by_words = model.escape and self.defined is None and not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        plain = [w.replace(SPACE.encode(), b" ") for w in self.written]
        self.plain = np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)])

    def _cutter(self) -> re.Pattern:
        """Parts that no piece crosses: a space begins one, and so does a sign that in no piece follows
        anything but spaces and such signs."""
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            return re.compile(r"(?s).+")
        opening = {c for c in {*map(chr, range(128)), *"".join(self.ids)} - {SPACE} if not c.isalpha()}
        while bad := {b for a, b in self.beside if b in opening and a not in opening and a != SPACE}:
            opening -= bad
        signs = "".join(re.escape(c) for c in sorted(opening))
        return re.compile(f"{SPACE}*[^{SPACE}{signs}]+|{SPACE}*[{signs}]+[^{SPACE}{signs}]*|{SPACE}+" if signs else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def _edge(self, piece: int, right: bool) -> list[tuple[float, str]]:
        """The merges that make a piece, in order: each one's cost, and the symbol then at the edge.
        The first entry is the start, the last one's cost is never reached."""
        known = self.edges.get((piece, right))
        if known is None:
            symbols, costs, states = list(self.texts[piece]), [], []
            while True:
                states.append(symbols[-1 if right else 0])
                best, at = None, -1
                for i in range(len(symbols) - 1):
                    merged = self.ids.get(symbols[i] + symbols[i + 1])
                    if merged is not None and (best is None or self.cost[merged] < best):
                        best, at = self.cost[merged], i
                if at < 0:
                    break
                costs.append(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            known = list(zip([*costs, float("inf")], states, strict=True))
            if len(symbols) > 1:  # merging never makes this piece
                known = []
            self.edges[piece, right] = known
        return known

    def weight(self, a: int, b: int) -> float:
        """Of the arc of piece b after piece a (-1: after a fallback, -2: at the beginning)."""
        if self.model.kind == UNIGRAM:
            return self.cost[b]
        allowed = self.compatible(a, b) if a >= 0 else bool(self._edge(b, False))
        return self.cost[b] if allowed else INFINITY

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b gives a and b: no merge across is ever the next one."""
        if self.texts[a][-1] + self.texts[b][0] not in self.beside:
            return bool(self._edge(a, True) and self._edge(b, False))
        left, right = self._edge(a, True), self._edge(b, False)
        if not left or not right:
            return False
        i = j = 0
        while True:
            across = self.ids.get(left[i][1] + right[j][1])
            cost = self.cost[across] if across is not None else float("inf")
            x, y = left[i][0], right[j][0]
            if x <= cost and x <= y and x != float("inf"):  # of equals, the leftmost goes first
                i += 1
            elif y < cost:
                j += 1
            else:
                return cost == float("inf")

    def path(self, text: str) -> list[int]:
        """Pieces on the path of least weight through a part; -1 stands for a fallback arc."""
        n = len(text)
        total = [0.0] + [INFINITY] * n
        last: list[int] = [-2] * (n + 1)
        size = [1] * (n + 1)
        pairs, many, weight, one = self.pairs, self.many, self.weight, self.model.kind == BPE
        whole = self.alone.issuperset(text)  # no character needs a fallback
        settled = 0
        for end, (k, piece) in self.arcs.iter(text) if self.ids else ():
            if not whole and settled < end:
                settled = self._settle(text, settled, end, total, last, size)
            i = end + 1
            if one and total[i] < INFINITY:
                continue
            before = last[i - k]
            cost = pairs.get(before * many + piece)
            if cost is None:
                cost = pairs[before * many + piece] = weight(before, piece)
            if total[i - k] + cost < total[i]:
                total[i], last[i], size[i] = total[i - k] + cost, piece, k
        if not whole:
            self._settle(text, settled, n, total, last, size)
        if len(pairs) > self.memory:
            pairs.clear()
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def _settle(self, text: str, at: int, to: int, total: list[float], last: list[int], size: list[int]) -> int:
        """Fallback arcs into the places after ``at`` up to ``to``, which no other arcs come into any more."""
        for i in range(at + 1, to + 1):
            if text[i - 1] not in self.ids and total[i - 1] + self.unknown_cost < total[i]:
                total[i], last[i], size[i] = total[i - 1] + self.unknown_cost, -1, 1
        return to

    def fallback_arc(self, symbol: str, again: bool) -> list[int]:
        """What an arc of the fallback writes; ``again``: it follows another one."""
        if self.fallback:
            return [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]
        return [] if again else [self.unknown]

    def _ids(self, text: str) -> list[int]:
        """What the path through a part writes."""
        path, out = self.path(text), []
        if -1 not in path:
            return path
        at, again = 0, False
        for piece in path:
            if piece >= 0:
                out.append(piece)
                at += len(self.texts[piece])
            else:
                out += self.fallback_arc(text[at], again)
                at += 1
            again = piece < 0
        return out

    def part(self, text: str) -> bytes:
        """A part's ids as 32-bit numbers."""
        known = np.array(self._ids(text), "<i4").tobytes()
        if len(text) < 64:
            if len(self.parts) > self.memory:
                self.parts.clear()
            self.parts[text] = known
        return known

    def word(self, word: str) -> bytes:
        """The same of a space and what stands behind it, up to the next one."""
        known, more = self.parts.get, self.part
        parts = self.cut.findall(SPACE + word)
        return known(parts[0]) or more(parts[0]) if len(parts) == 1 else b"".join([known(p) or more(p) for p in parts])

    def packed(self, text: str) -> bytes:
        """A text's ids as little-endian 32-bit numbers."""
        known, more, text = self.parts.get, self.part, self.normalise(text)
        if self.by_words and text[:1] == SPACE and SPACE * 2 not in text:
            # a word's own form stands for itself with a space, which never is a part without one
            words, one = self.words.get, self._new_word
            return b"".join([words(w) or one(w) for w in text[1:].split(SPACE)])
        if self.defined is None:
            return b"".join([known(p) or more(p) for p in self.cut.findall(text)])
        pieces = enumerate(self.defined.split(text))
        return b"".join([np.array([self.own[x]], "<i4").tobytes() if i % 2 else b"".join([known(p) or more(p) for p in self.cut.findall(x)]) for i, x in pieces])

    def _new_word(self, word: str) -> bytes:
        known = self.word(word)
        if len(word) < 32 and "\n" not in word:
            if len(self.words) > self.memory:
                self.words.clear()
            self.words[word] = known
        return known

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.normalise.back(b"".join(map(self.written.__getitem__, ids)).decode("utf-8", "replace"))

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts of many ids end to end, cut at ``bounds``, as bytes; broken UTF-8 as it is."""
        data, offs = self.plain
        size = (offs[1:] - offs[:-1])[ids]
        out = data[ragged(offs[ids], size)]
        cuts = np.concatenate(([0], np.cumsum(size)))[bounds]
        drop = self.model.dummy_prefix
        return [out[a + (drop and a < b and out[a] == 32) : b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_compiled: dict[str, Transducer] = {}


def transducer(data: bytes, memory: int = 600_000) -> Transducer:
    """Compiled once per process."""
    key = f"{hashlib.sha256(data).hexdigest()} {memory}"
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(Model.parse(data), memory)
    return _compiled[key]


RESULTS = "ids array<int>, n_pieces long, n_bytes long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode_documents(docs: DataFrame, model_path: str = DEFAULT_MODEL, keep_ids: bool = True, memory: int = 600_000) -> DataFrame:
    """``docs`` (any columns; text) with ids, n_pieces, n_bytes (pieces of byte fallback), ids_sha256 (of
    the ids as little-endian 32-bit numbers), decoded_sha256 and round_trip.

    ``memory``: how many parts of texts, and pairs of pieces, a worker remembers.  The model is read on the
    driver and broadcast: its size does not depend on the data.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    made = _parse_datatype_string(RESULTS).fields
    docs = docs.drop(*(f.name for f in made))
    schema = StructType([*docs.schema.fields, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model.value, memory)
        on_other_work(_compiled.clear)
        of_bytes = np.zeros(t.many, bool)
        of_bytes[list(t.byte_of)] = True
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(batch.schema.get_field_index("text")).fill_null("").to_pylist()
                packed = [t.packed(text) for text in texts]
                flat = np.frombuffer(b"".join(packed), "<i4")
                bounds = np.cumsum([0, *map(len, packed)]).astype(np.int32) // 4
                decoded, same, sha = [], [], [hashlib.sha256(p).hexdigest() for p in packed]
                for text, back, ids in zip(texts, t.decode_many(flat, bounds), packed, strict=True):
                    same.append(back == text.encode("utf-8", "surrogatepass"))
                    if not same[-1]:
                        back = t.decode(np.frombuffer(ids, "<i4").tolist()).encode("utf-8", "surrogatepass")
                    decoded.append(hashlib.sha256(back).hexdigest())
                n_bytes = np.concatenate(([0], np.cumsum(of_bytes[flat])))[bounds]
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)) if keep_ids else pa.nulls(len(sha), pa.list_(pa.int32()))
                results = [ids, pa.array(np.diff(bounds).astype(np.int64)), pa.array(np.diff(n_bytes)), pa.array(sha, pa.string()), pa.array(decoded, pa.string()), pa.array(same)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *results], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """``encoded`` (any columns; ids) with decoded, the text that the ids stand for (null ids: the empty text)."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())
    encoded = encoded.drop("decoded")
    schema = StructType(encoded.schema.fields[:]).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model.value)
        on_other_work(_compiled.clear)
        for batch in batches:
            texts = [t.decode(x.as_py() or []) for x in batch.column(batch.schema.get_field_index("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def tokenise(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, ids and what is said of them: n_pieces, n_bytes, ids_sha256, decoded_sha256, round_trip."""
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return encode_documents(docs, model_path).drop("text").select("doc_id", "ids", "n_pieces", "n_bytes", "ids_sha256", "decoded_sha256", "round_trip")
