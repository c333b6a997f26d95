"""Personal data with a semi-Markov conditional random field.

Base patterns find e-mail addresses, IP addresses, card and phone numbers.  A
semi-Markov CRF then reads the regions around digits and at-signs again: whole
spans of at most ``MAX_TOKENS`` tokens are scored by features of the span (shape,
digit count, separators, checksum, neighbours), and a dynamic program over spans
chooses boundaries and types together.  A span that the model is sure of
(``SURE``) and that touches no base span is added.

The model is fitted on the base findings in a bounded sample: the regions of at
most ``fit_rows`` documents of least hash that hold a digit or at-sign, whole
texts.  Every document is then scored whole.

Defined results: a NULL text is empty; repeated rows each get their row; without
any base finding in the sample the model adds nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import hash_sample, ship_with_tasks

ship_with_tasks(__name__)

KINDS = ("email", "ip", "card", "phone")
#: Bounds of an entity: tokens, and digits.
MAX_TOKENS, MAX_DIGITS, LEAST_DIGITS = 12, 24, 4
FIT_ROWS = 400
#: Longer texts are no training examples: rows and characters bound what the driver holds.
FIT_CHARS = 20_000
EPOCHS = 6
RATE = 0.1
DECAY = 1e-4
SURE = 0.95
MEMO = 100_000

# The base patterns, anchored so that no start inside a run is tried twice.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_HINT = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Checksum of card numbers."""
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Base findings by kind as listed, then start (code points, end exclusive)."""
    if not _HINT.search(text):
        return []
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append(("email", lo, m.end()))
            done = m.end()
        else:
            done = max(done, at)  # later local parts cannot reach back over an at-sign
        at = text.find("@", max(at + 1, m.end() if m else 0))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]  # a part may be any number of digits long
        if all(len(p) < 4 and int(p) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S|\s+")


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Spans of text worth reading: runs of words that hold a digit or at-sign."""
    if not _HINT.search(text):
        return
    start = end = None
    for m in re.finditer(r"\S+", text):
        if _HINT.search(m[0]):
            if start is not None and m.start() == end + 1 and text[end] == " ":
                end = m.end()
                continue
            if start is not None:
                yield start, end
            start, end = m.span()
    if start is not None:
        yield start, end


def _number(n: int) -> str:
    return str(n) if n <= 20 else "many"


def span_features(text: str, lo: int, hi: int) -> list[str]:
    """Features of a whole candidate span."""
    s = text[lo:hi]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    letters = any(c.isalpha() for c in s)
    separators = "".join(sorted(set(re.sub(r"[^\W_]", "", s))))[:6]
    before = text[max(0, lo - 12):lo]
    word = re.search(r"([^\W\d_]+)\W*$", before)
    out = ["bias", f"digits={_number(len(digits))}", f"groups={_number(len(groups))}", f"sep={separators}", f"letters={letters}",
           f"sep,digits={separators},{_number(len(digits))}", f"at={s.count('@')}", f"first={_shape(s[:1])}", f"last={_shape(s[-1:])}",
           f"left={_shape(text[lo - 1:lo] if lo else '')}", f"right={_shape(text[hi:hi + 1])}"]
    if 13 <= len(digits) <= 19 and not letters:
        out.append(f"luhn={luhn(digits)}")
    if len(groups) == 4 and not letters:
        out.append(f"octets={all(len(g) < 4 and int(g) < 256 for g in groups)}")
    if "@" in s:
        out.append(f"dotted={'.' in s[s.rfind('@'):]},{letters}")
    if s.startswith("+"):
        out.append(f"plus={9 <= len(digits) <= 15}")
    if word and word[1].lower() in {"tel", "phone", "call", "mail", "email", "card", "ip", "fax", "mobile"}:
        out.append(f"cue={word[1].lower()}")
    return out


def _shape(c: str) -> str:
    return "end" if not c else "0" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


class Region:
    """Tokens of a region and its candidate spans (first token, last token + 1, features)."""

    def __init__(self, text: str, lo: int, hi: int):
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
        self.starts, self.ends, self.n = [a for a, _ in tokens], [b for _, b in tokens], len(tokens)
        self.spans = []
        opens = [text[a] == "+" or text[a] == "(" or text[a].isalnum() for a in self.starts]
        closes = [text[b - 1].isalnum() for b in self.ends]
        for i in range(self.n):
            if not opens[i]:
                continue
            digits = at_signs = 0
            letters = blank = False
            for j in range(i, min(i + MAX_TOKENS, self.n)):
                token = text[self.starts[j]:self.ends[j]]
                digits += len(token) if token[0].isdigit() else 0
                letters |= token[0].isalpha()
                at_signs += token == "@"
                blank |= token[0].isspace()
                if digits > MAX_DIGITS or "\n" in token or blank and (letters or at_signs):
                    break
                # Numbers hold no letters; addresses hold an at-sign and no blank.
                if closes[j] and (at_signs == 1 and not blank or not at_signs and not letters and digits >= LEAST_DIGITS):
                    self.spans.append((i, j + 1, span_features(text, self.starts[i], self.ends[j])))


class SpanModel:
    """Semi-Markov CRF: labels 0 (outside, one token) and 1.. (``KINDS``, whole spans)."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS)))
        self.moves = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        self.memo: dict[tuple, bool] = {}

    def _may_be_sure(self, span: tuple[int, int, list[str]]) -> bool:
        """Whether a span could reach ``SURE``: against the same segmentation with the span's tokens
        outside, its odds are at most this; so regions without such a span need no program."""
        i, j, names = span
        key = (j - i, *names)
        if (able := self.memo.get(key)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            score = self.weights[[self.index[x] for x in names if x in self.index]].sum(axis=0)
            outside = (self.moves[:, :1] + (j - i - 1) * self.moves[0, 0])[:, None, :] + self.moves[0][None, :, None]
            inside = self.moves[:, None, 1:] + self.moves[1:, :].T[None, :, :] + score
            able = self.memo[key] = bool((inside - outside).max() >= np.log(SURE))
        return able

    def _vectors(self, region: Region, grow: bool = False) -> list[tuple[int, int, np.ndarray]]:
        out = []
        for i, j, names in region.spans:
            if grow:
                for name in names:
                    self.index.setdefault(name, len(self.index))
            out.append((i, j, np.array([self.index[x] for x in names if x in self.index], np.int64)))
        return out

    def _lattice(self, n: int, spans: list) -> tuple[list, np.ndarray, np.ndarray, list]:
        """Span scores, forward and backward log sums and the spans by end."""
        labels = len(KINDS) + 1
        scores = [self.weights[f].sum(axis=0) for *_, f in spans]
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, _) in enumerate(spans):
            by_end[j].append(k)
            by_start[i].append(k)
        forward, backward = np.full((n + 1, labels), -np.inf), np.full((n + 1, labels), -np.inf)
        forward[0, 0], backward[n] = 0.0, 0.0
        for j in range(1, n + 1):
            forward[j, 0] = np.logaddexp.reduce(forward[j - 1] + self.moves[:, 0])
            for k in by_end[j]:
                into = np.logaddexp.reduce(forward[spans[k][0]][:, None] + self.moves[:, 1:], axis=0)
                forward[j, 1:] = np.logaddexp(forward[j, 1:], into + scores[k])
        for i in range(n - 1, -1, -1):
            acc = self.moves[:, 0] + backward[i + 1, 0]
            for k in by_start[i]:
                acc = np.logaddexp(acc, np.logaddexp.reduce(self.moves[:, 1:] + scores[k] + backward[spans[k][1], 1:], axis=1))
            backward[i] = acc
        return scores, forward, backward, by_end

    def marginals(self, n: int, spans: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Probability of every (span, kind), of every (label, label) move, summed, and log Z."""
        scores, forward, backward, _ = self._lattice(n, spans)
        z = np.logaddexp.reduce(forward[n])
        made, moves = np.zeros((len(spans), len(KINDS))), np.zeros_like(self.moves)
        for k, (i, j, _) in enumerate(spans):
            p = np.exp(forward[i][:, None] + self.moves[:, 1:] + scores[k] + backward[j, 1:] - z)
            made[k] = p.sum(axis=0)
            moves[:, 1:] += p
        for i in range(n):
            moves[:, 0] += np.exp(forward[i] + self.moves[:, 0] + backward[i + 1, 0] - z)
        return made, moves, forward, z

    def best(self, n: int, spans: list) -> list[tuple[int, int]]:
        """Chosen (span number, kind number) of the most probable segmentation."""
        labels = len(KINDS) + 1
        top, back = np.full((n + 1, labels), -np.inf), [[None] * labels for _ in range(n + 1)]
        top[0, 0] = 0.0
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j, _) in enumerate(spans):
            by_end[j].append(k)
        for j in range(1, n + 1):
            come = top[j - 1] + self.moves[:, 0]
            top[j, 0], back[j][0] = come.max(), (j - 1, int(come.argmax()), None)
            for k in by_end[j]:
                i, _, f = spans[k]
                come = top[i][:, None] + self.moves[:, 1:] + self.weights[f].sum(axis=0)
                for y in range(1, labels):
                    if (v := come[:, y - 1].max()) > top[j, y]:
                        top[j, y], back[j][y] = v, (i, int(come[:, y - 1].argmax()), k)
        j, y, out = n, int(top[n].argmax()), []
        while j > 0:
            i, before, k = back[j][y]
            if k is not None:
                out.append((k, y - 1))
            j, y = i, before
        return out[::-1]

    def fit(self, examples: list[tuple[Region, dict[tuple[int, int], int]]]) -> SpanModel:
        """Gradient ascent, scaled by each weight's past gradients, on the log-likelihood of the gold segmentations ({(first, end): kind})."""
        data = [(r.n, self._vectors(r, True), gold) for r, gold in examples]
        self.weights = np.zeros((len(self.index), len(KINDS)))
        past, past_moves = np.full_like(self.weights, 1e-2), np.full_like(self.moves, 1e-2)
        for _ in range(EPOCHS):
            for n, spans, gold in data:
                made, moves, *_ = self.marginals(n, spans)
                change: dict[int, np.ndarray] = {}
                for k, (i, j, f) in enumerate(spans):
                    push = -made[k]
                    if (i, j) in gold:
                        push[gold[i, j]] += 1.0
                    if np.abs(push).max() > 1e-4:
                        for at in f.tolist():
                            change[at] = change[at] + push if at in change else push.copy()
                if change:
                    at, push = np.array(list(change)), np.array(list(change.values()))
                    push -= DECAY * self.weights[at]
                    past[at] += push ** 2
                    self.weights[at] += RATE * push / np.sqrt(past[at])
                push = _gold_moves(n, gold) - moves
                past_moves += push ** 2
                self.moves += RATE * push / np.sqrt(past_moves)
        return self

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans of ``text`` that the model is sure of and that touch no base span."""
        if not len(self.weights):
            return []
        out = []
        taken = np.zeros(len(text) + 1, np.int64)  # characters of base spans before each place
        for _, a, b in base:
            taken[a + 1:b + 1] = 1
        np.cumsum(taken, out=taken)
        for lo, hi in regions(text):
            region = Region(text, lo, hi)
            free = {s[:2] for s in region.spans if self._may_be_sure(s) and taken[region.starts[s[0]]] == taken[region.ends[s[1] - 1]]}
            if not free:
                continue
            spans = self._vectors(region)
            chosen = [(k, y) for k, y in self.best(region.n, spans) if spans[k][:2] in free]
            if chosen:
                made = self.marginals(region.n, spans)[0]
                out += [(KINDS[y], region.starts[spans[k][0]], region.ends[spans[k][1] - 1]) for k, y in chosen if made[k, y] >= SURE]
        return out


def _gold_moves(n: int, gold: dict[tuple[int, int], int]) -> np.ndarray:
    """Label moves of a gold segmentation."""
    moves, at, label = np.zeros((len(KINDS) + 1, len(KINDS) + 1)), 0, 0
    ends = {i: (j, y + 1) for (i, j), y in gold.items()}
    while at < n:
        to, y = ends.get(at, (at + 1, 0))
        moves[label, y] += 1
        at, label = to, y
    return moves


def examples_of(text: str) -> Iterator[tuple[Region, dict[tuple[int, int], int]]]:
    """Training regions of a text, with the base findings that their tokens can express."""
    base = base_spans(text)
    for lo, hi in regions(text):
        region = Region(text, lo, hi)
        able = {(region.starts[i], region.ends[j - 1]): (i, j) for i, j, _ in region.spans}
        inside = sorted((a, b, k) for k, a, b in base if lo <= a and b <= hi)
        if any(b > a2 for (_, b, _), (a2, _, _) in zip(inside, inside[1:], strict=False)) or any((a, b) not in able for a, b, _ in inside):
            continue  # overlapping findings, or longer than a span may be
        yield region, {able[a, b]: KINDS.index(k) for a, b, k in inside}


# Ways to write personal data that the base patterns do not know: (kind, what is replaced, by what).
VARIANTS = (
    ("card", re.compile(r"(?<=[0-9])[ -]?(?=[0-9])"), "."), ("card", re.compile(r"(?<=[0-9])[ -]?(?=[0-9])"), "/"),
    ("ip", re.compile(r"\."), ","), ("ip", re.compile(r"\."), ". "),
    ("email", re.compile(r"\.(?=[^@]*$)"), ","), ("email", re.compile(r"\.(?=[^@]*$)"), ";"),
    ("phone", re.compile(r"^\+"), "00"), ("phone", re.compile(r"^\+|[ ().-]+"), "/"),
)


def vary(kind: str, found: str, turn: int) -> str:
    """``found`` in a form that the base patterns miss; cards keep groups of four, as they are printed."""
    _, what, by = [v for v in VARIANTS if v[0] == kind][turn % 2]
    if kind == "card":
        digits = _NOT_DIGIT.sub("", found)
        return by.join(digits[i:i + 4] for i in range(0, len(digits), 4))
    return what.sub(by, found).strip("/") if kind == "phone" and by == "/" else what.sub(by, found)


def varied_text(text: str, turn: int) -> tuple[str, list[Span]]:
    """``text`` with its base findings written otherwise, and where they are; findings that overlap stay as they are."""
    out, spans, done = [], [], 0
    for lo, hi, kind in sorted((lo, hi, kind) for kind, lo, hi in base_spans(text)):
        if lo < done:
            continue
        out.append(text[done:lo])
        start = sum(map(len, out))
        out.append(vary(kind, text[lo:hi], turn + len(spans)))
        spans.append((kind, start, start + len(out[-1])))
        done = hi
    return "".join([*out, text[done:]]), spans


def examples_of_varied(text: str, turn: int) -> Iterator[tuple[Region, dict[tuple[int, int], int]]]:
    """Training regions of a text whose findings are written in a way that the base patterns miss."""
    text, spans = varied_text(text, turn)
    for lo, hi in regions(text):
        region = Region(text, lo, hi)
        able = {(region.starts[i], region.ends[j - 1]): (i, j) for i, j, _ in region.spans}
        inside = [(a, b, k) for k, a, b in spans if lo <= a and b <= hi]
        if inside and all((a, b) in able for a, b, _ in inside):
            yield region, {able[a, b]: KINDS.index(k) for a, b, k in inside}


def fit_model(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> SpanModel:
    """Fit on at most ``fit_rows`` distinct texts with a digit or at-sign, of at most ``fit_chars`` characters each.

    Every text is an example as it stands, where the gold spans are the base findings, and with those
    findings written in a way that the base patterns miss.
    """
    texts = docs.where(F.col(text_col).rlike("[0-9@]") & (F.length(text_col) <= fit_chars)).select(F.col(text_col).alias("text")).distinct()
    rows = sorted(r.text for r in hash_sample(texts, fit_rows, "text").collect())
    examples = [e for t in rows for e in examples_of(t)]
    examples += [e for n, t in enumerate(rows) for e in examples_of_varied(t, n)]
    return SpanModel().fit(examples) if any(gold for _, gold in examples) else SpanModel()


def _find_batches(model: SpanModel):
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                base = base_spans(text or "")
                more = model.added(text or "", base)
                rows = [(KINDS.index(k), a, b, True) for k, a, b in base] + [(KINDS.index(k), a, b, False) for k, a, b in more]
                found.append([{"kind": KINDS[k], "start": a, "end": b, "base": x} for k, a, b, x in sorted(rows)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(span))], [*batch.schema.names[1:], "found"])
    return run


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and found (array of kind, start, end, base; by kind as listed, then start) per row."""
    model = fit_model(docs, text_col, fit_rows)
    src = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_find_batches(model), f"doc_id {kind}, found array<struct<kind:string,start:long,end:long,base:boolean>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` with every found span replaced by ``[kind]`` (columns as given)."""
    model = fit_model(docs, text_col, fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else _masked(t, model) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, model: SpanModel) -> str:
    base = base_spans(text)
    out, done = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in base + model.added(text, base)):
        if b <= done:
            continue
        out += [text[done:max(a, done)], f"[{kind}]"]
        done = b
    return "".join([*out, text[done:]])
