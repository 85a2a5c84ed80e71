"""Personal data by weak supervision.

Base matches (email, ip, card, phone) are exact patterns and always stay. Around them the method looks
for further spans: a broad candidate generator, five labelers (shape patterns, checksums, gazetteers,
context cues, triviality) that vote yes / no / abstain, an expectation-maximisation step that estimates each
labeler's reliability from the vote patterns of all documents, and a final logistic span classifier
trained on the resulting posteriors. A candidate that the classifier accepts becomes a span.

The corpus pass returns only counts per (votes, features) pattern; there are at most
3^5 votes x 8 kinds x 32 shapes of these whatever the input, so what reaches the driver is bounded.

Edge cases: a null text counts as empty and has no spans; a null id is carried through; repeated rows are
each answered; an empty table gives an empty result; extra columns are ignored (``redact`` keeps them). Every search takes time in proportion to the text,
so very long texts are searched whole. Of candidates that overlap, the first to start stays, then the longest, then the kind listed first.
Offsets count code points, end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import strings, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "national_id", "name")
KINDS = BASE_KINDS + ADDED_KINDS

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")  # a run of digits that fails at its start fails further in too
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_SPELLED = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]+)+")  # what follows the local part
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\+[0-9]{1,3}[\x20-])?\(?[0-9]{2,4}\)?[\x20-][0-9]{3}[\x20-][0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NAME = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? ((?:[A-ZÀ-Þ][a-zß-ÿ]+)(?: [A-ZÀ-Þ][a-zß-ÿ]+){0,2})")

# Gazetteers and cue words of the labelers.
_TLDS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl be ch at pl se no dk fi pt ie eu us ca au jp cn in br mx ru example".split())
_CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421".split())
_GIVEN = frozenset("james mary john anna peter paul maria jose juan ana luis carlos pierre jean marie hans klaus karl thomas michael david sarah laura julia martin andreas stefan daniel robert william emma sophie louis hugo lucia elena".split())
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "22", "23", "24", "25", "26", "27")
_CUES = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel", "write to"),
    "ip": ("ip", "host", "server", "client", "login", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono", "contact"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "national_id": ("ssn", "social security", "national id", "tax id"),
    "name": ("name", "contact", "dear", "patient", "signed", "regards"),
}
_AGAINST = ("version", "section", "isbn", "rfc", "license", "page", "article", "order no", "part no", "serial")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _with_local_part(text: str, rest: re.Pattern):
    """Matches of ``rest`` that have a local part before them, with it; what an earlier match took is not used again."""
    end = 0
    for m in rest.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            end = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _with_local_part(text, _AT)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Possible further spans, none of which overlap: the first to start, then the longest, then the kind listed first; none over a base span."""
    out = []
    if "at)" in text or "at]" in text or "at}" in text:
        out += [("email", a, b) for a, b in _with_local_part(text, _SPELLED)]
    if _DIGIT.search(text):
        out += [("phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
        out += [("national_id", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
        out += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text)]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= sum(c not in " -" for c in m.group()) <= 19]
    out += [("name", m.start(1), m.end(1)) for m in _NAME.finditer(text)]
    starts, ends = [], []  # the base spans as disjoint stretches in order
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    kept, end = [], 0
    for kind, s, e in sorted(out, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        at = bisect.bisect_left(starts, e) - 1
        if s >= end and (at < 0 or ends[at] <= s):
            kept.append((kind, s, e))
            end = e
    return kept


def _vote(cond: bool) -> int:
    return 1 if cond else -1


def votes(text: str, kind: str, s: int, e: int, strict: bool) -> tuple[int, ...]:
    """Shape, checksum, gazetteer, context and triviality labelers: 1 yes, -1 no, 0 abstains."""
    span = text[s:e]
    digits = "".join(c for c in span if "0" <= c <= "9")
    shape = 1 if strict else {"email": 0, "phone": 0, "national_id": 1, "iban": 1, "card": 0, "name": 0}.get(kind, 0)
    checksum = 0
    if kind == "card":
        checksum = _vote(luhn(digits))
    elif kind == "iban":
        checksum = _vote(mod97(span))
    elif kind == "national_id":
        checksum = _vote(digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000")
    gazetteer = 0
    if kind == "email":
        gazetteer = _vote(re.split(r"[^A-Za-z0-9]+", span.rstrip(")]}"))[-1].lower() in _TLDS)
    elif kind == "phone" and span.startswith("+"):
        gazetteer = _vote(digits.startswith(_CALLING))
    elif kind == "card":
        gazetteer = _vote(digits.startswith(_ISSUERS))
    elif kind == "name":
        gazetteer = 1 if any(w.lower() in _GIVEN for w in span.split()) else 0
    before = text[max(0, s - 32) : s].lower()
    context = 1 if any(c in before for c in _CUES[kind]) else -1 if any(c in before for c in _AGAINST) else 0
    trivial = -1 if digits and (len(set(digits)) <= 2 or digits in "01234567890123456789") else 0
    return shape, checksum, gazetteer, context, trivial


def shape_code(text: str, s: int, e: int) -> int:
    """Four shape bits for the final classifier: separators, brackets, letters, own line."""
    span = text[s:e]
    own = (s == 0 or text[s - 1] == "\n") and (e == len(text) or text[e] == "\n")
    return (any(c in " -" for c in span)) | (any(c in "()[]{}" for c in span)) << 1 | (any(c.isalpha() for c in span)) << 2 | own << 3


def pattern(text: str, span: tuple[str, int, int], strict: bool) -> int:
    code = 0
    for v in votes(text, *span, strict):
        code = code * 3 + v + 1
    return ((code * 8 + KINDS.index(span[0])) * 2 + strict) * 16 + shape_code(text, span[1], span[2])


def _decode(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shape, rest = patterns % 16, patterns // 32
    kind, code = rest % 8, rest // 8
    v = np.empty((len(patterns), 5), int)
    for j in range(4, -1, -1):
        v[:, j], code = code % 3, code // 3
    return v, kind, shape  # votes as 0 no, 1 abstains, 2 yes


def _features(patterns: np.ndarray) -> np.ndarray:
    v, kind, shape = _decode(patterns)
    cols = [np.ones(len(patterns))]
    for j in range(5):
        cols += [(v[:, j] == 0) * 1.0, (v[:, j] == 2) * 1.0]
    cols += [(kind == k) * 1.0 for k in range(len(KINDS))]
    cols += [((shape >> b) & 1) * 1.0 for b in range(4)]
    return np.stack(cols, 1)


@dataclass
class SpanModel:
    """Reliabilities (P(vote | class) per labeler) and the classifier's weights."""

    reliability: list
    prior: float
    weights: list

    def score(self, patterns: list[int]) -> list[float]:
        if not patterns:
            return []
        z = _features(np.array(patterns)) @ np.array(self.weights)
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


def fit(counts: dict[int, int], rounds: int = 50) -> SpanModel:
    """EM over vote patterns, then weighted logistic regression on the posteriors.

    Base spans are known to be personal data: they inform the labelers' reliabilities, while the share of personal data
    is that among the other candidates. Starts from the majority vote; Dirichlet smoothing keeps every labeler better than chance at
    the start, so the two classes keep their meaning. With no candidates at all the smoothing alone decides.
    """
    p = np.array(sorted(counts), int)
    n = np.array([counts[x] for x in sorted(counts)], float)
    start = np.array([[0.60, 0.30, 0.10], [0.10, 0.30, 0.60]])  # P(no, abstains, yes) for class 0, 1
    theta, prior = np.repeat(start[:, None, :], 5, 1), 0.5
    if len(p):
        v, _, _ = _decode(p)
        onehot = (v[:, :, None] == np.arange(3)) * 1.0
        base = p // 16 % 2 == 1
        open_ = n * ~base
        q = np.where(base, 1.0, 1 / (1 + np.exp(-(v - 1).sum(1) * 1.0)))
        strength = 0.02 * n.sum() + 4
        for _ in range(rounds):
            for c, w in ((0, n * (1 - q)), (1, n * q)):
                t = np.einsum("i,ijk->jk", w, onehot) + strength * start[c]
                theta[c] = t / t.sum(1, keepdims=True)
            prior = ((open_ * q).sum() + 2) / (open_.sum() + 4)
            log = np.einsum("ijk,cjk->ic", onehot, np.log(theta)) + np.log([1 - prior, prior])
            q = np.where(base, 1.0, 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30))))
        # base spans weigh as much as all other candidates together
        w = np.where(base, n / max(1.0, (n * base).sum()), n / max(1.0, open_.sum()))
        x, w = _features(p), w / w.sum()
    else:
        x, w, q = np.zeros((0, 22)), np.zeros(0), np.zeros(0)
    beta = np.zeros(22)
    for _ in range(40):  # Newton steps with a small ridge
        mu = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (mu - q)) + 1e-3 * beta
        hess = (x * (w * mu * (1 - mu))[:, None]).T @ x + 1e-3 * np.eye(22)
        beta = beta - np.linalg.solve(hess, grad)
    return SpanModel(theta.tolist(), float(prior), beta.tolist())


def _count_patterns(batches):
    for b in batches:
        seen: Counter = Counter()
        for text in strings(b.column(0)):
            base = base_spans(text)
            for s in base:
                seen[pattern(text, s, True)] += 1
            for s in candidates(text, base):
                seen[pattern(text, s, False)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])


def learn(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Fit the span model on every document of ``docs``."""
    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(_count_patterns, "pattern long, n long")
    return fit({r["pattern"]: r["n"] for r in counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})


def find(text: str, model: SpanModel, threshold: float = 0.5) -> tuple[list, list]:
    """(base spans, added spans) of one text."""
    base = base_spans(text)
    extra = candidates(text, base)
    scores = model.score([pattern(text, s, False) for s in extra])
    return base, [s for s, p in zip(extra, scores, strict=True) if p >= threshold]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


SPAN_DDL = "kind string, start int, end int, base boolean"


def detect(docs: DataFrame, model: SpanModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans array<struct<kind, start, end, base>> by kind as listed, then start."""
    model = model or learn(docs, text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            out = []
            for text in strings(b.column(1)):
                base, extra = find(text, model)
                spans = [(*s, True) for s in base] + [(*s, False) for s in extra]
                spans.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
                out.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["id", "spans"])

    t = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {t}, spans array<struct<{SPAN_DDL}>>").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """The contract's columns, from ``find`` on each whole text."""
    model = model or learn(docs)

    def run(batches):
        for b in batches:
            rows = []
            for text in strings(b.column(1)):
                base, extra = find(text, model)
                n = Counter(k for k, _, _ in base)
                sha = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*(n[k] for k in BASE_KINDS), sha, joined(base + extra)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    ddl = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, ddl)


def redact(docs: DataFrame, model: SpanModel | None = None, text_col: str = "text") -> DataFrame:
    """Replace every span by ``[KIND]``; all other columns stay, ``n_chars`` (if there) follows the text."""
    model = model or learn(docs, text_col)

    def run(batches):
        for b in batches:
            out = []
            for text in strings(b.column(text_col)):
                if text is not None:
                    base, extra = find(text, model)
                    parts, at = [], 0
                    for kind, s, e in sorted(base + extra, key=lambda x: (x[1], -x[2])):
                        if s >= at:
                            parts += [text[at:s], f"[{kind.upper()}]"]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]]) if at else text
                out.append(text)
            i = b.schema.get_field_index(text_col)
            yield b.set_column(i, b.schema.field(i).with_type(pa.string()), pa.array(out, pa.string()))

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
