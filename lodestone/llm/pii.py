"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans are what four patterns with their checks find. The field labels the number-like and address-like words of a document ("mentions") with a kind
or none. Neighbouring mentions share a chain potential; mentions of a document that repeat each other, or have the same shape, share a skip potential with a
node of their group, however many they are and however far apart. Mentions inside base spans are observed; loopy message passing carries their labels to the others, so a
card number whose check digit was mistyped takes the label of the same or similar ones elsewhere in its document. Base spans always stay.

The field is trained by pseudo-likelihood on a bounded sample of documents, with the base spans as labels. Its features are shapes, never the
checks themselves.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lean

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. No match of ``ip`` can begin inside a run of digits, which the look-behind saves trying.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HINT = re.compile(r"[0-9@]")
_RUN = re.compile(r"\S+")
#: Mentions are the number-like and address-like pieces of what stands between white space, however long that is.
_PIECE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*|\+?\(?[0-9](?:[().-]{0,2}[0-9])*")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Documents that the field is trained on at most, and the longest text among them, so that the driver's sample is bounded. Predictions take every text whole.
SAMPLE_DOCUMENTS, SAMPLE_LONGEST = 3000, 1 << 16
THRESHOLD = 0.5
#: Messages of a document are passed until none changes by more than SETTLED. If that takes more than SLOW rounds, damping rises; MOST_ROUNDS only
#: ends what goes round in circles, as loopy message passing may.
SETTLED, SLOW, MOST_ROUNDS = 1e-4, 100, 2000
#: Rows that are passed on together; documents and their characters whose messages are.
ROWS = 1000
GROUP_DOCUMENTS, GROUP_CHARACTERS = 200, 1 << 20
#: Agreement weights that training starts from and decays to: of mentions that repeat each other, and of those alike in shape.
PRIOR = (2.0, 0.5)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: whether one exists is decided by what follows its @, so each @ is tried once, from the start of its local part."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        if at >= floor:
            local = text[floor:at]
            start = floor + len(local.rstrip(_LOCAL))
            found = _DOMAIN.match(text, at + 1) if start < at else None
            if found:
                yield start, found.end()
                floor = found.end()
            else:
                floor = at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of all kinds, by start and then kind. Matches that fail their check are dropped without another try."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# The field ------------------------------------------------------------------------------------------------------------

LABELS = ("none", *KINDS)
#: Words before and after a mention count by a hash, in so many features each.
WORDS = 64
FEATURES = 40 + 2 * WORDS
#: The feature that a mention has right after another one.
BEFORE = 34


@dataclass
class Mentions:
    """Mentions of one or more documents: places, features, observed labels (-1: none) and edges (first, second, 0 chain, 1 same, 2 alike).

    Groups are nodes too, numbered after all mentions; ``groups`` has their documents. The second node of a same or alike edge is a group; the first one of an
    alike edge is a mention or a group of same ones.
    """

    document: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    observed: np.ndarray
    edges: np.ndarray
    groups: np.ndarray


def _word_feature(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS


def _features(word: str, before: bool, after: bool, touches: tuple[bool, bool] = (False, False), near: tuple[str, str] = ("", "")) -> list[int]:
    """Numbers of the features that a mention has. touches: whether letters stand right before and after it; near: the words before and after it."""
    digits = sum(c.isdigit() for c in word)
    letters = sum(c.isalpha() for c in word)
    dots = word.count(".")
    out = [0, 1 + min(digits, 19), 21 + min(dots, 4)]
    for k, has in enumerate((digits == len(word), letters == 0, "@" in word, word[:1] == "+", "(" in word, "-" in word, letters > digits, "=" in word or '"' in word, before, after, *touches)):
        if has:
            out.append(26 + k)
    return out + [40 + WORDS * k + _word_feature(w) for k, w in enumerate(near) if w]


def _places(text: str) -> Iterator[tuple[int, int, str, tuple[bool, bool], tuple[str, str]]]:
    """(start, end, word, whether letters touch it, words before and after) of each mention: the number-like and address-like pieces of runs without white space."""
    last: list | None = None  # the run's last mention waits for the word after it
    word = ""
    for m in _RUN.finditer(text):
        run, base = m[0], m.start()
        if last is not None:
            found = _LETTERS.search(run)
            yield (*last, (word, found[0] if found else ""))
            last, word = None, ""
        if not _HINT.search(run):
            word = run
            continue
        done = 0
        for piece in _PIECE.finditer(run):
            a, b = piece.span()
            found = _LETTERS.findall(run[done:a])
            if last is not None:
                yield (*last, (word, found[0] if found else ""))
                word = ""
            if found:
                word = found[-1]
            elif word:
                letters = _LETTERS.findall(word)
                word = letters[-1] if letters else ""
            last = [base + a, base + b, piece[0], (a > 0 and run[a - 1].isalpha(), b < len(run) and run[b].isalpha())]
            done = b
        if last is None:
            word = run
    if last is not None:
        yield (*last, (word, ""))


def _next_to(text: str, end: int, start: int) -> bool:
    """Whether nothing but one white-space character lies between."""
    return start - end == 1 and text[end].isspace()


def mentions(documents: list[tuple[int, str, list[Span]]]) -> Mentions:
    """Of (number, text, base spans) per document. A mention has a chain edge to the one before it in the text if only one white-space character lies between. Those with the
    same letters and digits share a group, and such groups, or mentions alone with theirs, share one with all others of the same shape."""
    doc, start, end, rows, observed, edges = [], [], [], [], [], []
    groups: list[int] = []
    tied: list[tuple[int, int, int]] = []  # edges to groups: these are numbered from -1 down until the mentions are known
    for number, text, spans in documents:
        places = list(_places(text))
        same: dict[str, list[int]] = {}
        shapes: dict[str, dict[str, int]] = {}  # by shape: the keys that have it, and the first mention of each
        at = 0
        for k, (a, b, word, touches, near) in enumerate(places):
            here = len(doc)
            while at < len(spans) and spans[at][2] <= a:
                at += 1
            label, next_span = -1, at
            while next_span < len(spans) and spans[next_span][1] < b:
                if a < spans[next_span][2]:
                    label = LABELS.index(spans[next_span][0])
                    break
                next_span += 1
            before = k > 0 and _next_to(text, places[k - 1][1], a)
            after = k + 1 < len(places) and _next_to(text, b, places[k + 1][0])
            rows.append(_features(word, before, after, touches, near))
            doc.append(number), start.append(a), end.append(b), observed.append(label)
            if before:
                edges.append((here - 1, here, 0))
            text_key = "".join(c for c in word.lower() if c.isalnum())
            shape = re.sub(r"[a-z]+", "a", re.sub(r"[0-9]", "9", word.lower()))
            same.setdefault(text_key, []).append(here)
            shapes.setdefault(shape, {}).setdefault(text_key, here)
        node: dict[str, int] = {}
        for text_key, members in same.items():
            if len(members) > 1:
                groups.append(number)
                node[text_key] = -len(groups)
                tied += [(i, -len(groups), 1) for i in members]
        for keys in shapes.values():
            if len(keys) > 1:
                groups.append(number)
                tied += [(node.get(text_key, i), -len(groups), 2) for text_key, i in keys.items()]
    edges += [tuple(i if i >= 0 else len(doc) - 1 - i for i in e[:2]) + e[2:] for e in tied]
    found = np.zeros((len(doc), FEATURES), np.float32)
    for k, row in enumerate(rows):
        found[k, row] = 1
    as_array = lambda x: np.array(x, np.int64)
    return Mentions(as_array(doc), as_array(start), as_array(end), found, as_array(observed), as_array(edges).reshape(-1, 3), as_array(groups))


def _votes(m: Mentions, truth: np.ndarray) -> list[np.ndarray]:
    """By same and by alike: the share of each label among the other members of each mention's group. Those of an alike group are groups of same mentions, which
    count once each, by their shares, and mentions alone."""
    n, nodes = len(m.document), len(m.document) + len(m.groups)
    u, v, kind = m.edges.T
    share = np.zeros((nodes, truth.shape[1]))
    share[:n] = truth
    rest = []
    for k in (1, 2):
        a, b = u[kind == k], v[kind == k]
        total, members = np.zeros_like(share), np.bincount(b, minlength=nodes)
        np.add.at(total, b, share[a])
        others = np.zeros_like(share)
        np.add.at(others, a, (total[b] - share[a]) / (members[b] - 1)[:, None])
        rest.append(others)
        at = np.unique(b)
        share[at] = total[at] / members[at, None]
    a, b = u[kind == 1], v[kind == 1]
    rest[1][a] += rest[1][b]  # what a group of same mentions hears from those alike goes to each of them
    return [r[:n] for r in rest]


@dataclass
class SkipChain:
    """unary [features, labels], chain [label before, label], and agreement weights of same and alike mentions."""

    unary: np.ndarray
    chain: np.ndarray
    agree: np.ndarray

    @classmethod
    def fit(cls, m: Mentions, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> SkipChain:
        """Pseudo-likelihood: each mention given its neighbours' labels and those of its groups, as shares of the other members. Without mentions the weights stay as they are at first."""
        labels = len(LABELS)
        self = cls(np.zeros((FEATURES, labels)), np.zeros((labels, labels)), np.array(PRIOR))
        n = len(m.document)
        if not n:
            return self
        y = np.maximum(m.observed, 0)
        truth = np.eye(labels)[y]
        u, v, kind = m.edges.T
        chain = kind == 0
        votes = _votes(m, truth)
        left, right = np.zeros((n, labels)), np.zeros((n, labels))
        np.add.at(left, v[chain], truth[u[chain]])
        np.add.at(right, u[chain], truth[v[chain]])
        for _ in range(steps):
            score = m.features @ self.unary + left @ self.chain + right @ self.chain.T + self.agree[0] * votes[0] + self.agree[1] * votes[1]
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            wrong = (truth - p) / n
            self.unary += rate * (m.features.T @ wrong - decay * self.unary)
            self.chain += rate * (left.T @ wrong + wrong.T @ right - decay * self.chain)
            self.agree += rate * (np.array([(wrong * c).sum() for c in votes]) - decay * (self.agree - PRIOR))
        return self

    def marginals(self, m: Mentions) -> np.ndarray:
        """Label probabilities of each mention once messages have settled; observed mentions keep their label. Documents don't affect each other."""
        n, labels = len(m.document), len(LABELS)
        score = np.zeros((n + len(m.groups), labels))
        score[:n] = m.features @ self.unary
        seen = np.flatnonzero(m.observed >= 0)
        score[seen] = -50.0
        score[seen, m.observed[seen]] = 50.0
        u, v, kind = m.edges.T
        same = np.eye(labels)
        tables = np.stack([self.chain, self.agree[0] * same, self.agree[1] * same])
        owner = np.unique(np.concatenate([m.document, m.groups]), return_inverse=True)[1][u]  # a number for each edge's document
        message = np.zeros((2, len(u), labels))  # forth and back along each edge
        belief = score.copy()
        busy = np.arange(len(u))
        for k in range(MOST_ROUNDS):
            if not len(busy):
                break
            a, b, along = u[busy], v[busy], tables[kind[busy]]
            old = message[:, busy]
            out = np.stack([(belief[a] - old[1])[:, :, None] + along, (belief[b] - old[0])[:, :, None] + along.transpose(0, 2, 1)])
            top = out.max(2, keepdims=True)
            fresh = np.log(np.exp(out - top).sum(2)) + top[:, :, 0]
            fresh -= fresh.max(2, keepdims=True)
            change = np.abs(fresh - old).max((0, 2))
            keep = 0.5 if k < SLOW else 0.9
            message[:, busy] = fresh = keep * old + (1 - keep) * fresh
            nodes = np.unique(np.concatenate([a, b]))
            belief[nodes] = score[nodes]
            np.add.at(belief, b, fresh[0])
            np.add.at(belief, a, fresh[1])
            most = np.zeros(owner.max() + 1)
            np.maximum.at(most, owner[busy], change)
            busy = busy[most[owner[busy]] > SETTLED]
        belief = belief[:n]
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, m: Mentions) -> list[tuple[int, Span]]:
        """(document, span) of mentions outside base spans that get a kind; neighbours of one kind join to one span."""
        p = self.marginals(m)
        best = p.argmax(1)
        out: list[tuple[int, Span]] = []
        last = -2
        for i in np.flatnonzero((m.observed < 0) & (best > 0) & (p.max(1) > THRESHOLD)).tolist():
            kind = LABELS[best[i]]
            if last == i - 1 and out[-1][0] == m.document[i] and out[-1][1][0] == kind and m.features[i, BEFORE]:
                out[-1] = (out[-1][0], (kind, out[-1][1][1], int(m.end[i])))
            else:
                out.append((int(m.document[i]), (kind, int(m.start[i]), int(m.end[i]))))
            last = i
        return out


def train(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> SkipChain:
    """Fits the field on at most ``documents`` whole texts with a mention, those of least hash of doc_id and text; texts over SAMPLE_LONGEST teach nothing. An empty table gives the field as it is at first."""
    some = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_LONGEST)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    n = some.count()
    if 1.2 * documents < n:  # somewhat more than are needed, whatever the table's size; repeated rows have one hash
        some = some.where(F.col("h") < int(-(2.0**63) + 2.0**64 * 1.2 * documents / n))
    rows = sorted(some.groupBy("h").agg(F.min("text").alias("text")).collect(), key=lambda r: r["h"])[:documents]
    texts = sorted(r["text"] for r in rows)
    return SkipChain.fit(mentions([(k, t, base_spans(t)) for k, t in enumerate(texts)]))


def _spans_of(texts: list[str | None], field: SkipChain) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if t and _HINT.search(t) else [] for t in texts]
    noted = [(k, t, base[k]) for k, t in enumerate(texts) if t and _HINT.search(t)]
    more: dict[int, list[Span]] = {}
    group: list[tuple[int, str, list[Span]]] = []
    for at, one in enumerate(noted):
        group.append(one)
        if at + 1 == len(noted) or len(group) >= GROUP_DOCUMENTS or sum(len(t) for _, t, _ in group) >= GROUP_CHARACTERS:
            for k, span in field.added(mentions(group)):
                more.setdefault(k, []).append(span)
            group = []
    return [(spans, sorted(spans + more.get(k, []), key=lambda s: (s[1], KINDS.index(s[0])))) for k, spans in enumerate(base)]


def find(docs: DataFrame, field: SkipChain) -> DataFrame:
    """Adds base and spans (arrays of kind, start, end in code points) to docs; null texts have none. Columns of these names are replaced, all others stay. An empty table gives an empty result."""
    kept = [c for c in docs.columns if c not in ("base", "spans")]
    text_at = kept.index("text")
    source = docs.select(*kept)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda lists: pa.array([[{"kind": s[0], "start": s[1], "end": s[2]} for s in x] for x in lists], kind)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            base, both = zip(*_spans_of(batch.column(text_at).to_pylist(), field))
            yield pa.RecordBatch.from_arrays([*batch.columns, as_rows(base), as_rows(both)], names=[*kept, "base", "spans"])

    span = "array<struct<kind:string,start:int,end:int>>"
    return source.mapInArrow(lean(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields), f"base {span}", f"spans {span}"]))


def report(docs: DataFrame, field: SkipChain) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans as text. Repeated rows and null ids stay rows of their own; texts of any length are looked through whole; other columns are dropped. An
    empty table gives an empty result."""
    found = find(docs.select("doc_id", "text"), field)
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def redacted(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in angle brackets; spans that overlap are replaced together, by the first one's kind."""
    out, end = [], 0
    for kind, start, stop in spans:
        if start >= end:
            out += [text[end:start], f"<{kind.upper()}>"]
        end = max(end, stop)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, field: SkipChain) -> DataFrame:
    """docs with redacted texts. n_chars follows if there is one; all other columns stay as they are."""
    columns = docs.columns
    text_at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            texts = batch.column(text_at).to_pylist()
            arrays = list(batch.columns)
            arrays[text_at] = pa.array([redacted(t, spans) if spans else t for t, (_, spans) in zip(texts, _spans_of(texts, field))], arrays[text_at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    out = docs.mapInArrow(lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()
