"""BPE encoding and decoding by a tokenisation automaton.

The automaton accepts exactly the token sequences that the merge list makes. It is built by
successive merge gadgets: at first one state carries every base symbol as a loop; the gadget of a
merge (u, v) -> w splits the state that u leads to into a copy without an arc for v (after a plain u
no plain v may follow), and lets every state that has an arc for u have one for w, which leads where v
leads. All arcs of one label lead to one state, so the gadgets are kept as tables; whether a state has
an arc is read from these and remembered. A prefix of a word has one accepted sequence, so a word is
encoded by keeping, for each of its prefixes, the one last arc that reaches its end; decoding emits the
arcs' labels.

Defined cases: a null text is an empty one (no ids, empty decoded text); one result row per input
row, repeated rows and null ids included; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from weftline.llm.state import small_batches
from weftline.llm.text import releasing, text_slices

_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_MARK = "\n"  # no letter of a byte-level vocabulary
_ODD_BREAKS = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(f"[{_SPACE}]+")
#: Entries that each of a worker's two memories holds at most.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: a byte that prints
    as itself in Latin-1 stands for itself, the others take the letters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeAutomaton:
    """The automaton of a merge list over base symbols; labels are token strings.

    The states that a label u leads to are a chain of copies, one for each merge (u, v), and go on
    where the chain of u's right part stood when u was made. The label w stands, before the merge that
    made it, for its left part. So a state lacks an arc for w if and only if, going back in time along
    both, a merge of the pair that they stand for at that time is met.
    """

    def __init__(self, base: list[str], merges: list[tuple[str, str]]):
        self.labels = list(base)
        self.left, self.right = array("i", [-1] * len(base)), array("i", [-1] * len(base))
        self.born = array("i", [0] * len(base))  # a label's merge, from 1; 0: base
        self.split: dict[tuple[int, int], int] = {}  # (u, v): the gadget that took the arc for v from the state behind u
        self.dead: set[int] = set()
        number = {label: k for k, label in enumerate(base)}
        for turn, (u, v) in enumerate(merges, 1):
            if u not in number or v not in number:
                raise ValueError(f"merge {turn} joins a token that no earlier merge makes: {u!r} {v!r}")
            if u + v in number:
                raise ValueError(f"merge {turn} makes a token that exists: {u + v!r}")
            u, v, w = number[u], number[v], len(self.labels)
            self.labels.append(self.labels[u] + self.labels[v])
            number[self.labels[w]] = w
            self.left.append(u)
            self.right.append(v)
            self.born.append(turn)
            if u in self.dead or v in self.dead or not self.has_arc(u, v):
                self.dead.add(w)  # its parts never meet, so no state gets an arc for it
            else:
                self.split[u, v] = turn

    def has_arc(self, u: int, w: int) -> bool:
        """Whether the state that the arcs labelled u lead to has an arc labelled w."""
        left, right, born, split = self.left, self.right, self.born, self.split
        time = 1 << 30
        while True:
            if split.get((u, w), time + 1) <= time:
                return False
            if born[u] == born[w] == 0:
                return True
            if born[u] >= born[w]:
                time = min(time, born[u] - 1)  # u leads where its right part led just before
                u = right[u]
            else:
                time = min(time, born[w])  # the merge gave the arc to states as it left them
                w = left[w]


class BpeCodec:
    """Encodes as the tokenizer of a tokenizers JSON file does (NFC, lower case, word split, byte-level
    BPE with word ends), without adding special tokens; decodes as the library's decode() without a
    decoder, that is, with the tokens' labels joined by spaces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or spec.get("decoder"):
            raise ValueError("only NFC, white space, lower case and byte-level BPE without a decoder are known")
        self.end = model["end_of_word_suffix"] or ""
        self.ends = bool(self.end)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        letters = byte_letters()
        self.automaton = MergeAutomaton([*letters, *(x + self.end for x in letters)], merges)
        a = self.automaton
        self.ids = [model["vocab"][label] for label in a.labels]
        self.letters = letters
        # arcs by the base symbols that they spell; a mark after a word's last letter stands for its end
        self.count = len(a.labels)
        spelled = [x[: len(x) - len(self.end)] + _MARK if self.end and x.endswith(self.end) else x for x in a.labels]
        self.lengths = [len(x) for x in spelled]
        self.arcs = {x: k for k, x in enumerate(spelled) if k not in a.dead}
        self.spelled = ahocorasick.Automaton()
        for x, k in self.arcs.items():
            self.spelled.add_word(x, (k, len(x)))
        self.spelled.make_automaton()
        words = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.word = regex.compile(words.replace("\\s", _SPACE))
        self.unknown, self.newer, self.normal = _newer()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.arc_memory: dict[int, bool] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {}
        self.word_memory: dict[str, tuple[bytes, str]] = {}
        self.failed = 0

    def arcs_of(self, word: str) -> list[int]:
        """The labels of the accepted path over one pre-split word. Of the arcs that end at a place, longest
        first, the one that its start's last arc leads to is the last arc of the prefix up to that place."""
        text = "".join([self.letters[b] for b in word.encode()])
        if (whole := self.arcs.get(text + _MARK * self.ends)) is not None:
            return [whole]  # the one accepted sequence of the string that a live label spells is that label
        memory, count = self.arc_memory, self.count
        last: list[int] = [-1] * (len(text) + 1 + self.ends)
        done, text = -1, text + _MARK * self.ends
        for place, (label, length) in self.spelled.iter(text):
            if place == done:
                continue
            if start := place + 1 - length:
                key = last[start] * count + label
                if (known := memory.get(key)) is None:
                    if len(memory) > 1_000_000:
                        memory.clear()
                    known = memory[key] = self.automaton.has_arc(last[start], label)
                if not known:
                    continue
            last[place + 1] = label
            done = place
        path, stop = [], len(text)
        while stop:
            path.append(last[stop])
            stop -= self.lengths[last[stop]]
        return path[::-1]

    def _word(self, word: str) -> tuple[bytes, str]:
        if (known := self.word_memory.get(word)) is None:
            path = self.arcs_of(word)
            known = array("I", [self.ids[k] for k in path]).tobytes(), " ".join([self.automaton.labels[k] for k in path])
            self._remember(self.word_memory, word, known)
        return known

    def _words(self, piece: str) -> list[str]:
        """The pre-split words. Code points that only newer Unicode versions call letters or numbers are neither, as in the library."""
        if piece.isascii() or not self.newer.search(piece):
            return self.word.findall(piece)
        return [piece[m.start() : m.end()] for m in self.word.finditer(self.newer.sub("\ue000", piece))]

    def _piece(self, piece: str) -> tuple[bytes, str]:
        if (known := self.pieces.get(piece)) is None:
            parts = [self._word(w) for w in self._words(piece)]
            known = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))
            self._remember(self.pieces, piece, known)
        return known

    def _remember(self, memory: dict, key: str, known: tuple[bytes, str]) -> None:
        """A full memory keeps what it has, mostly frequent words, till it has failed often."""
        if len(key) > 64:
            return
        if len(memory) < REMEMBERED:
            memory[key] = known
            return
        self.failed += 1
        if self.failed > 10 * REMEMBERED:
            memory.clear()
            self.failed = 0

    def _has_unknown(self, text: str) -> bool:
        """Whether Python's Unicode version lacks a code point of the text; it knows all that Latin-1 can write."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.unknown.search(text) is not None
        return False

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        if not text.isascii() and self._has_unknown(text):
            text = self.normal.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma
        words = [w for w in _SPACES.split(text) if w] if _ODD_BREAKS.search(text) else text.split()
        parts = list(map(self.pieces.get, words))
        if None in parts:
            piece = self._piece
            parts = [p or piece(w) for p, w in zip(parts, words, strict=True)]
        return parts

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if self.specials is None or not self.specials.search(text):
            parts = self._plain(text)
        else:
            parts = []
            for k, part in enumerate(self.specials.split(text)):
                parts += [(array("I", [self.special[part]]).tobytes(), part)] if k % 2 else self._plain(part)
        if not parts:
            return b"", ""
        ids, labels = zip(*parts, strict=True)
        return b"".join(ids), " ".join(labels)

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs with these ids."""
        if not hasattr(self, "label_of"):
            self.label_of = dict(zip(self.ids, self.automaton.labels, strict=True)) | {v: k for k, v in self.special.items()}
        return " ".join([self.label_of[k] for k in array("I", ids)])


def _ranges(codes: list[int]) -> regex.Pattern:
    """What matches one of the code points, in order."""
    known = set(codes)
    starts, stops = ([k for k in codes if k + d not in known] for d in (-1, 1))
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, stops, strict=True)) + "]") if codes else regex.compile("(?!)")


def _newer() -> tuple[regex.Pattern, regex.Pattern, normalizers.Normalizer]:
    """The code points that Python's Unicode version lacks and the pattern module's knows; those among them that the library doesn't
    take for the letters or numbers that the pattern module does, by its own answers; and the library's normal form for the first."""
    some, named = regex.compile(r"\P{Cn}"), regex.compile(r"[\p{L}\p{N}]")
    odd = [k for k in range(sys.maxunicode + 1) if unicodedata.category(chr(k)) == "Cn" and some.match(chr(k))]
    left = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}\s]"), "removed").pre_tokenize_str(" ".join(map(chr, odd)))
    plain = {ord(c) for piece, _ in left for c in piece}
    return _ranges(odd), _ranges([k for k in odd if k in plain and named.match(chr(k))]), normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


_codecs: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    """One codec for each file and worker process."""
    if path not in _codecs:
        _codecs[path] = BpeCodec(path)
    return _codecs[path]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of docs: the id, n_tokens, ids (array<int>; if with_ids), ids_sha256 and
    decoded_sha256. path: a tokenizers JSON file that each worker can read. Narrow: no shuffle."""
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for batch in text_slices(whole):
                rows = [c.encode(t or "") for t in batch.column("text").to_pylist()]
                columns = [
                    batch.column("doc_id"),
                    pa.array([len(ids) // 4 for ids, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in rows], pa.string()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *(len(ids) // 4 for ids, _ in rows)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join([ids for ids, _ in rows]), np.int32)))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(releasing(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded: the labels of the tokens in ids_col, joined by spaces; null for null."""

    @F.pandas_udf("string")
    def labels(column):
        c = codec(path)
        return column.map(lambda ids: None if ids is None else c.decode(array("I", [int(k) for k in ids]).tobytes()))

    return encoded.withColumn("decoded", labels(F.col(ids_col)))
