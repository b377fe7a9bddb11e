"""Personal data: four fixed patterns, and a linear-chain conditional random field for other spellings.

The patterns find e-mail addresses, IP addresses, card and phone numbers in their plain forms. The field adds
spans of the same kinds in other forms (bracketed "at" and "dot", national phone numbers, addresses with
bracketed dots, cards in groups with other marks). Its features are word shapes: runs of digits with their
lengths, runs of letters, marks; of the word itself and of its neighbours. It is trained on the labelled
table below, by Adam on the exact likelihood. A word that has no digit and no bracket or @, and stands by no
bracketed word, can only be outside; so the words between such ones are decoded as sequences of their own, and
Viterbi runs over batches of sequences of one length in numpy.

Defined cases: a null text is an empty one, without spans; a span of the field that meets a pattern's span is
dropped; one result row per input row, repeated rows and null ids included; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.state import small_batches
from weftline.llm.text import releasing, text_bytes, text_slices, words

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# starts behind a digit can't match where the run's first digit didn't
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Labelled rows; # is any digit. Fixed values.
TABLE = """
write to <email>anna (at) example (dot) org</email> for more
contact <email>j.smith [at] mail.example.com</email> today
reach <email>info(at)example.com</email> or come by
mail <email>sales[at]shop[dot]example[dot]net</email> please
his address <email>bob##(at)mail#.example.com</email> is old
send it to <email>mary.jones {at} example {dot} com</email> now
ask <email>team [at] example [dot] org</email> about it
at <email>bob## (at) mail#.example.com</email> or by phone
mail <email>anna (at) mail.example.com</email> now
mail <email>bob## (at) mail#.example.com</email> <phone>(###) ###-####</phone> now
mail <email>anna (at) example.com</email> <phone>###-###-####</phone> or call
mail <email>anna [at] example.org</email> <phone>###.###.####</phone> or call
call <phone>(###) ###-####</phone> <email>j.smith [at] mail.example.com</email> now
call <phone>###-###-####</phone> <email>j.smith (at) mail.example.com</email> now
call <phone>###-###-####</phone> <phone>(###) ###-####</phone> now
from <ip>###[.]##[.]###[.]#</ip> <phone>###-###-####</phone> came
call <phone>(###) ###-####</phone> today
call us at <phone>###-###-####</phone> before noon
phone <phone>###.###.####</phone> or write
tel <phone>(###)###-####</phone> at any time
fax <phone>### ### ####</phone> is open
dial <phone>#-###-###-####</phone> for help
dial <phone># (###) ###-####</phone> for help
ring <phone>+# (###) ###-####</phone> soon
ring <phone>+## ## #### ####</phone> soon
ring <phone>+#%%% (###)%%% ###-####%%%</phone> the others
server <ip>###[.]##[.]###[.]#</ip> answered
host <ip>##[.]###[.]##[.]###</ip> was down
from <ip>##(.)##(.)##(.)##</ip> came traffic
from <ip>###[.]###[.]##[.]##</ip> came traffic
card <card>####.####.####.####</card> was charged
card <card>####/####/####/####</card> was charged
paid with <card>####_####_####_####</card> last week
in the year #### it began
in #### and #### it rained
at ##:## we left
about ## people came
some ### of them
version #.#.# is out
version ##.#.# is out
the value #.## rose to ##.## then
it cost $##.## or $###.## there
section (a) and (b) hold
note [#] and [##] say so
see (####) and (##) for it
(the others) came (at last) home
he said (at noon) that it rained
a number ################ stands here
the code "#a##b###c##d####e" is set
the hash ##af##cd####bb##ee is set
token = "####a#b#c##d###e##f####" in a file
room ### on floor #
page ##-## of ###
from ####-##-## to ####-##-##
on ##/##/#### or ##.##.#### then
the score ###-### was called
###-#### alone stands there
chapter ## verse ##
a#b##c and x## are names
#st #nd and #rd came
## ## ## ## were drawn
marks # # # (#) stood there
rows # ## # and (#) (##) stood
[edit] the (dot) on the line
a [dot] here and an (at) there
ratio #:## was given (see #.#)
copyright (c) #### by all
#### #### people came
##% of ##,### and #,###,### too
""".strip().split("\n")

_EDGE = ".,;:!?\"'`»«)”“’…*%&$#|"
_RUN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_BRACKETED = re.compile(r"[(\[{](?:at|dot)[)\]}]|\[\.\]|\(\.\)", re.I)
_SPECIAL = np.zeros(256, bool)
_SPECIAL[[*b"0123456789@()[]{}"]] = True


def shape(word: str) -> str:
    """Digits as d, by their number up to 4 and then D; letters as a; bracketed at and dot as they are."""
    out = []
    for part in re.split(f"({_BRACKETED.pattern})", word, flags=re.I):
        if _BRACKETED.fullmatch(part):
            out.append(part.lower())
        else:
            for run in _RUN.findall(part):
                out.append(("d" * len(run) if len(run) <= 4 else "D") if run[0] in "0123456789" else "a" if run[0].isalpha() else run[0] if run[0] in "@.-+()[]{}/:_$\"," else "*")
    return "".join(out)


def _features(tokens: list[str]) -> list[list[str]]:
    shapes = ["", *(shape(t.rstrip(_EDGE)) for t in tokens), ""]
    out = []
    for k, token in enumerate(tokens, 1):
        s = shapes[k]
        digits = len(_DIGIT.findall(token))
        out.append([
            "bias", f"s={s}", f"p={shapes[k - 1]}", f"n={shapes[k + 1]}", f"s={s}|p={shapes[k - 1]}", f"s={s}|n={shapes[k + 1]}",
            f"d={min(digits, 17)}", f"f={s[:1]}", f"l={s[-1:]}", f"@={bool(_BRACKETED.search(token))}", f"c={''.join(sorted(set(s)))}",
        ])
    return out


class Field:
    """A linear-chain CRF with the labels O and, per kind, B (first word) and I (further words)."""

    labels = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]

    def __init__(self) -> None:
        n = len(self.labels)
        self.allowed = np.ones((n, n), bool)
        self.first = np.ones(n, bool)
        for j, label in enumerate(self.labels):
            if label[0] == "I":
                self.first[j] = False
                self.allowed[:, j] = False
                self.allowed[[j, j - 1], j] = True
        self.index: dict[str, int] = {}
        self.emission = np.zeros((0, n))
        self.transition = np.zeros((n, n))

    def fit(self, rows: list[tuple[list[str], list[int]]], steps: int = 250, rate: float = 0.08, l2: float = 2e-3) -> Field:
        listed = [_features(tokens) for tokens, _ in rows]
        for token in (t for row in listed for t in row):
            for f in token:
                self.index.setdefault(f, len(self.index))
        n, longest = len(self.labels), max(len(r) for r in listed)
        ids = np.full((len(rows), longest, len(listed[0][0])), len(self.index))
        gold = np.zeros((len(rows), longest), np.int64)
        sizes = np.array([len(r) for r in listed])
        for k, (row, (_, labels)) in enumerate(zip(listed, rows, strict=True)):
            for t, features in enumerate(row):
                ids[k, t] = [self.index[f] for f in features]
            gold[k, : len(labels)] = labels
        real = np.arange(longest) < sizes[:, None]
        w, trans = np.zeros((len(self.index) + 1, n)), np.zeros((n, n))
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
        wall = np.where(self.allowed, 0.0, -1e9)
        at = np.arange(len(rows))
        for step in range(1, steps + 1):
            e = w[ids].sum(2)
            e[:, 0] += np.where(self.first, 0.0, -1e9)
            t = trans + wall
            forward = np.zeros((len(rows), longest, n))
            forward[:, 0] = e[:, 0]
            for k in range(1, longest):
                forward[:, k] = np.where(real[:, k, None], e[:, k] + _logsum(forward[:, k - 1, :, None] + t, 1), forward[:, k - 1])
            backward = np.zeros((len(rows), longest, n))
            for k in range(longest - 2, -1, -1):
                backward[:, k] = np.where(real[:, k + 1, None], _logsum(t + (e[:, k + 1] + backward[:, k + 1])[:, None], 2), 0)
            total = _logsum(forward[:, -1], 1)[:, None]
            marginal = np.exp(forward + backward - total[..., None]) * real[..., None]
            marginal[at[:, None], np.arange(longest), gold] -= real
            grad_w, grad_t = l2 * w * len(rows), l2 * trans * len(rows)
            np.add.at(grad_w, ids.reshape(-1), np.repeat(marginal.reshape(-1, n), ids.shape[2], 0))
            for k in range(1, longest):
                joint = np.exp(forward[:, k - 1, :, None] + t + (e[:, k] + backward[:, k])[:, None] - total[..., None]) * real[:, k, None, None]
                grad_t += joint.sum(0)
                np.add.at(grad_t, (gold[real[:, k], k - 1], gold[real[:, k], k]), -1.0)
            grad_w[-1] = 0
            for value, grad, a, b in ((w, grad_w, *moments[:2]), (trans, grad_t, *moments[2:])):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad**2 - b)
                value -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        self.emission, self.transition = w, trans + wall
        return self

    def decode(self, sequences: list[list[str]]) -> list[list[int]]:
        """The best labels of each sequence, by Viterbi over all sequences of one length at once."""
        out: list[list[int]] = [[] for _ in sequences]
        by_size: dict[int, list[int]] = {}
        for k, s in enumerate(sequences):
            by_size.setdefault(len(s), []).append(k)
        none = len(self.index)
        for size, own in by_size.items():
            for start in range(0, len(own), 4096):
                part = own[start : start + 4096]
                ids = np.array([[[self.index.get(f, none) for f in token] for token in _features(sequences[k])] for k in part])
                e = self.emission[ids].sum(2)
                best = e[:, 0] + np.where(self.first, 0.0, -1e9)
                back = np.zeros((len(part), size, len(self.labels)), np.int64)
                for t in range(1, size):
                    paths = best[:, :, None] + self.transition
                    back[:, t] = paths.argmax(1)
                    best = paths.max(1) + e[:, t]
                path = np.zeros((len(part), size), np.int64)
                path[:, -1] = best.argmax(1)
                for t in range(size - 1, 0, -1):
                    path[:, t - 1] = back[np.arange(len(part)), t, path[:, t]]
                for k, labels in zip(part, path.tolist(), strict=True):
                    out[k] = labels
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def _open(token: str) -> bool:
    return any(c in "0123456789@()[]{}" for c in token)


def _sequences(tokens: list[str]) -> list[tuple[int, int]]:
    """The ranges of words that may be inside: those with a digit, bracket or @, and the neighbours of a bracketed at or dot."""
    may = [_open(t) for t in tokens]
    for k, t in enumerate(tokens):
        if may[k] and _BRACKETED.search(t):
            may[max(0, k - 1)] = may[min(len(tokens) - 1, k + 1)] = True
    out, start = [], None
    for k, m in enumerate([*may, False]):
        if m and start is None:
            start = k
        elif not m and start is not None:
            out.append((start, k))
            start = None
    return out


def labelled_rows(copies: int = 6, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """The training sequences: each row of the table with several draws of its digits, cut as texts are."""
    draw, rows = np.random.Generator(np.random.PCG64(seed)), []
    for line in TABLE:
        for _ in range(copies):
            filled = re.sub("#", lambda _: str(draw.integers(0, 10)), line)
            tokens, labels, kind = [], [], None
            for word in re.sub(r"(</?\w+>)", r" \1 ", filled).split():
                if word[:2] == "</":
                    kind = None
                elif m := re.fullmatch(r"<(\w+)>", word):
                    kind, begin = m[1], True
                else:
                    tokens.append(word)
                    labels.append(Field.labels.index(f"{'B' if begin else 'I'}-{kind}") if kind else 0)
                    begin = False
            rows += [(tokens[a:b], labels[a:b]) for a, b in _sequences(tokens)]
    return rows


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the fixed patterns, by kind and start, in code points."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def _candidates(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[str], list[tuple[int, int]]]]:
    """(row, words, their places in code points) of every sequence to decode."""
    starts, ends, rows = words(raw, offsets)
    if not len(starts):
        return []
    special = np.concatenate(([0], np.cumsum(_SPECIAL[raw])))
    may = special[ends] > special[starts]
    if not may.any():
        return []
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    data, out = raw.tobytes(), []
    owner = np.searchsorted(rows, np.flatnonzero(may), "right") - 1
    for row in np.unique(owner).tolist():
        a, b = rows[row], rows[row + 1]
        mine = np.flatnonzero(may[a:b]) + a
        # each special word with a neighbour on either side, as runs
        near = np.unique(np.clip(np.concatenate((mine - 1, mine, mine + 1)), a, b - 1))
        base = points[offsets[row]]
        for run in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1):
            tokens = [data[starts[k] : ends[k]].decode("utf-8", "replace") for k in run]
            places = [(int(points[starts[k]] - base), int(points[ends[k]] - base)) for k in run]
            out += [(row, tokens[x:y], places[x:y]) for x, y in _sequences(tokens)]
    return out


def _trim(token: str, start: int, stop: int, head: bool) -> tuple[int, int]:
    """A word's place without marks around it; only the first word of a span loses those before it."""
    while stop > start and token and token[-1] in _EDGE and not (token[-1] == ")" and "(" in token):
        token, stop = token[:-1], stop - 1
    while head and stop > start and token and token[0] in "\"'`«“‘":
        token, start = token[1:], start + 1
    return start, stop


def added_spans(field: Field, raw: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """For each row (kind, start, stop) of the field's spans."""
    found = _candidates(raw, offsets)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for (row, tokens, places), labels in zip(found, field.decode([tokens for _, tokens, _ in found]), strict=True):
        k = 0
        while k < len(labels):
            if labels[k] and labels[k] % 2:
                stop = k + 1
                while stop < len(labels) and labels[stop] == labels[k] + 1:
                    stop += 1
                a, b = _trim(tokens[k], *places[k], True)[0], _trim(tokens[stop - 1], *places[stop - 1], False)[1]
                if b > a:
                    out.setdefault(row, []).append((labels[k] // 2, a, b))
                k = stop
            else:
                k += 1
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_fields: dict[str, Field] = {}


def trained_field() -> Field:
    """The field of the table, trained once in a process."""
    if "own" not in _fields:
        _fields["own"] = Field().fit(labelled_rows())
    return _fields["own"]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card and n_phone (of the patterns), base_sha256 (of the patterns'
    spans), spans (all spans: kind:start:stop by kind and start, in code points), n_spans and n_all_email .. n_all_phone (how
    many these are, in all and by kind) and, if with_text, masked: the text with every span's place taken by its kind in
    angle brackets. Narrow."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    field = docs.sparkSession.sparkContext.broadcast(trained_field())
    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64()), *((f"n_all_{k}", pa.int64()) for k in KINDS)] + [("masked", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                added = added_spans(field.value, *text_bytes(batch.column("text")))
                out = []
                for row, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                    base = pattern_spans(text or "")
                    spans = sorted(base + [s for s in added.get(row, ()) if not any(s[1] < b and a < s[2] for _, a, b in base)])
                    counts = [sum(s[0] == k for s in base) for k in range(4)]
                    out.append((doc_id, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans), *(sum(s[0] == k for s in spans) for k in range(4)), *([None if text is None else mask(text, spans)] * with_text)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return docs.mapInArrow(releasing(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, " + ", ".join(f"n_all_{k} long" for k in KINDS) + ", masked string" * with_text)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with masked texts; a null text stays null; n_chars, if there is one, is the masked text's length. Narrow."""
    small_batches(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(trained_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole):
                added = added_spans(field.value, *text_bytes(batch.column("text")))
                texts = batch.column("text").to_pylist()
                for row, text in enumerate(texts):
                    base = pattern_spans(text or "")
                    if base or row in added:
                        texts[row] = mask(text, base + [s for s in added.get(row, ()) if not any(s[1] < b and a < s[2] for _, a, b in base)])
                yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, batch.column("text").type))

    masked = docs.mapInArrow(releasing(run), docs.schema)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with spans replaced by <kind>; of spans that meet, the first by place stands."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2], s[0])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])
