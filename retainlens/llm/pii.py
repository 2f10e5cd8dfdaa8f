"""Personal data by weak supervision (operator 4).

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Beside them, wider
patterns propose candidate spans of further kinds, and labelers of three sorts vote on each:
patterns (form, checksum), gazetteers (known prefixes, domains, country codes) and context (cue
words before the span, code-like surroundings). Expectation-maximisation over the counts of vote
patterns of all documents estimates each labeler's reliability per kind, and the posterior labels
train a logistic span classifier on votes and shape. Candidates that it accepts are added.

The corpus is gathered as counts of (kind, votes, shape), at most 7 * 3^5 * 32 rows however large
the corpus is; texts are read in one pass.

Defined cases: null text is empty; matches that fail a check are dropped without a retry; added
spans never overlap base spans or one another (higher probability, then earlier start wins);
repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, cut, slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret", "short_card", "ssn", "local_phone", "spaced_email")
LABELERS = 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its start fails from every later digit, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_+/-])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)")
_SPACED = re.compile(r"(?<![\w.@])[A-Za-z0-9._-]{2,40} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,40} ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,10}(?!\w)")

_COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK".split())
_PREFIXES = ("sk-", "pk_", "ghp_", "gho_", "glpat-", "xoxb-", "AKIA", "ASIA", "AIza", "eyJ")
_DOMAINS = ("com", "org", "net", "edu", "de", "fr", "es", "it", "uk", "eu", "io")
_CUES = {
    "iban": re.compile(r"iban|account|konto|compte|cuenta|bank", re.I),
    "secret": re.compile(r"token|secret|api.?key|passw|credential|auth|bearer|clave|schl.ssel", re.I),
    "ssn": re.compile(r"ssn|social security|tax|sozialversicherung|identity", re.I),
    "short_card": re.compile(r"card|visa|amex|credit|karte|carte|tarjeta", re.I),
    "local_phone": re.compile(r"phone|call|tel|mobile|fax|contact|anruf|llam", re.I),
    "spaced_email": re.compile(r"mail|contact|write|reach|address", re.I),
}
_CODE = re.compile(r"commit|sha1|sha256|md5|uuid|version|build|hash|isbn|https?://\S*$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind as listed, then start (code points, end exclusive)."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _only_digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_only_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _votes(kind: str, text: str, start: int, end: int) -> tuple[str, int]:
    """Votes of the labelers (0 abstains, 1 for, 2 against) as a string, and a shape bucket 0..31."""
    s = text[start:end]
    before, after = text[max(0, start - 40):start], text[end:end + 12]
    digits = _only_digits(s)
    letters = sum(c.isalpha() for c in s)
    if kind == "iban":
        form, known = 1 if _iban_ok(s) else 2, 1 if s[:2] in _COUNTRIES else 2
    elif kind == "secret":
        mixed = bool(digits) and bool(letters) and len(set(s)) >= 10
        form, known = 1 if mixed else 2, 1 if s.startswith(_PREFIXES) else 0
    elif kind == "ssn":
        form = 2 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
        known = 0
    elif kind == "short_card":
        form, known = 1 if luhn(digits) else 2, 1 if digits[:2] in ("34", "37", "36", "30", "38") else 0
    elif kind == "local_phone":
        form, known = 2 if digits[0] in "01" or digits[3] in "01" else 1, 1 if digits[3:6] == "555" else 0
    else:
        form, known = 1, 1 if s.rpartition(" ")[2].rpartition(".")[2].lower().rstrip(")]") in _DOMAINS else 2
    cue = 1 if _CUES[kind].search(before) else 0
    code = 2 if _CODE.search(before) else 0
    around = 1 if re.match(r"[\s\"',.;)]|$", after) and (not before or before[-1] in " \n\t\"'(:=") else 2
    n = min(3, len(s) // 12)
    share = min(3, int(4 * len(digits) / max(1, len(s))))
    return f"{form}{known}{cue}{code}{around}", n * 8 + share * 2 + (letters > 0 and s.upper() == s)


def candidate_spans(text: str) -> list[tuple[str, int, int, str, int]]:
    """(kind, start, end, votes, shape) of everything that the wider patterns propose."""
    found = []
    if any(map(text.__contains__, "0123456789")):
        found += [("iban", m) for m in _IBAN.finditer(text)]
        found += [("secret", m) for m in _SECRET.finditer(text)]
        if "-" in text:
            found += [("ssn", m) for m in _SSN.finditer(text)]
        found += [("local_phone", m) for m in _LOCAL_PHONE.finditer(text)]
        found += [("short_card", m) for m in _CARD.finditer(text) if 13 <= len(_only_digits(m[0])) <= 15]
    if "at)" in text or "at]" in text:
        found += [("spaced_email", m) for m in _SPACED.finditer(text)]
    return [(k, m.start(), m.end(), *_votes(k, text, m.start(), m.end())) for k, m in found]


# --- estimation on counts -------------------------------------------------------------------

def em_posteriors(votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Dawid-Skene with two classes: votes (patterns x labelers, 0 abstains), counts ->
    (probability of each pattern being personal data, reliabilities [labeler, class, vote])."""
    yes, no = (votes == 1).sum(1), (votes == 2).sum(1)
    q = (yes + 0.7) / (yes + no + 1.4)
    rel = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        prior = np.clip((q * n).sum() / n.sum(), 0.02, 0.98)
        like = np.log([1 - prior, prior])[None].repeat(len(votes), 0)
        for j in range(votes.shape[1]):
            for c, w in ((0, (1 - q) * n), (1, q * n)):
                # Prior counts: a labeler is rather right than wrong.
                rel[j, c] = np.bincount(votes[:, j], weights=w, minlength=3) + (np.array([4, 1, 3]) if c == 0 else np.array([4, 3, 1]))
                rel[j, c] /= rel[j, c].sum()
                like[:, c] += np.log(rel[j, c][votes[:, j]])
        q = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
    return q, rel


def _features(kind: str, votes: str, shape: int) -> np.ndarray:
    x = np.zeros(1 + len(ADDED) + 3 * LABELERS + 10)
    x[0], x[1 + ADDED.index(kind)] = 1, 1
    for j, v in enumerate(votes):
        x[1 + len(ADDED) + 3 * j + int(v)] = 1
    at = 1 + len(ADDED) + 3 * LABELERS
    x[at + shape // 8], x[at + 4 + shape // 2 % 4], x[at + 8 + shape % 2] = 1, 1, 1
    return x


def fit(scanned: DataFrame) -> dict[str, np.ndarray]:
    """The span classifier's weights, from the scanned candidates of all documents."""
    rows = scanned.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.shape").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted((r.kind, r.votes, r["shape"], r.n) for r in rows)
    if not rows:
        return {"w": np.zeros(1 + len(ADDED) + 3 * LABELERS + 10)}
    q = np.zeros(len(rows))
    for kind in ADDED:
        at = [i for i, r in enumerate(rows) if r[0] == kind]
        if at:
            q[at] = em_posteriors(np.array([[int(v) for v in rows[i][1]] for i in at]), np.array([rows[i][3] for i in at], float))[0]
    x, n = np.stack([_features(*r[:3]) for r in rows]), np.sqrt(np.array([r[3] for r in rows], float))
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of the weighted logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (n * (q - p)) - 0.1 * w)
    return {"w": w}


def probability(model: dict[str, np.ndarray], kind: str, votes: str, shape: int) -> float:
    return float(1 / (1 + np.exp(-np.clip(_features(kind, votes, shape) @ model["w"], -30, 30))))


def accept(base: list, candidates: list, prob) -> list[tuple[str, int, int]]:
    """The added spans: probable candidates that overlap neither base spans nor better ones."""
    taken, out = [(s, e) for _, s, e in base], []
    for p, kind, s, e in sorted(((prob(c[0], c[3], c[4]), c[0], c[1], c[2]) for c in candidates), key=lambda c: (-c[0], c[2], c[1])):
        if p >= 0.5 and all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            out.append((kind, s, e))
    return sorted(out, key=lambda c: (ADDED.index(c[0]), c[1]))


# --- Spark ----------------------------------------------------------------------------------

_CAND = "array<struct<kind:string,start:int,end:int,votes:string,shape:int>>"


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the text, and ``base`` and ``candidates`` of each text."""
    kept = [f for f in df.schema.fields if f.name not in (text, "base", "candidates")]
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    cand = pa.struct([*span, pa.field("votes", pa.string()), pa.field("shape", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            texts = [t or "" for t in column(part, text).to_pylist()]
            base = [[dict(zip(("kind", "start", "end"), s)) for s in base_spans(t)] for t in texts]
            more = [[dict(zip(("kind", "start", "end", "votes", "shape"), c)) for c in candidate_spans(t)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(column(part, f.name) for f in kept), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(cand))],
                names=[*(f.name for f in kept), "base", "candidates"])

    return df.select(*(f"`{f.name}`" for f in kept), text).mapInArrow(run, T.StructType([
        *kept, T.StructField("base", T._parse_datatype_string("array<struct<kind:string,start:int,end:int>>")),
        T.StructField("candidates", T._parse_datatype_string(_CAND))]))


def _memo(model):
    known: dict = {}

    def prob(*key):
        if key not in known:
            known[key] = probability(model, *key)
        return known[key]

    return prob


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without the text; counts and digest of base spans, and all spans as text."""
    made = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    scanned = cut(scan(df.drop(*made), text))  # spans only: the texts are read once
    model = fit(scanned)
    kept = [f for f in scanned.schema.fields if f.name not in ("base", "candidates")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prob = _memo(model)
        for b in batches:
            counts, shas, spans = [], [], []
            for base, cand in zip(column(b, "base").to_pylist(), column(b, "candidates").to_pylist()):
                base = [(x["kind"], x["start"], x["end"]) for x in base]
                added = accept(base, [(x["kind"], x["start"], x["end"], x["votes"], x["shape"]) for x in cand], prob)
                shown = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
                counts.append([sum(k == kind for k, _, _ in base) for kind in BASE])
                shas.append(hashlib.sha256(shown.encode()).hexdigest())
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in base + added))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(column(b, f.name) for f in kept), *(pa.array(n[:, i]) for i in range(4)), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                                             names=[*(f.name for f in kept), *made])

    return scanned.mapInArrow(run, T.StructType([
        *kept, *(T.StructField(c, T.LongType()) for c in made[:4]), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]))


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of a text replaced by its kind in angle brackets (null stays null)."""
    model = fit(cut(scan(df.select(text), text).select("candidates")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prob = _memo(model)
        for part in slices(batches, text):
            out = []
            for t in column(part, text).to_pylist():
                if t:
                    base = base_spans(t)
                    at, pieces = 0, []
                    # Base spans of different kinds may overlap: the union of them is replaced.
                    for kind, s, e in sorted(base + accept(base, candidate_spans(t), prob), key=lambda x: (x[1], -x[2])):
                        if s >= at:
                            pieces += [t[at:s], f"<{kind}>"]
                        at = max(at, e)
                    t = "".join(pieces) + t[at:]
                out.append(t)
            i = part.schema.get_field_index(text)
            yield part.set_column(i, part.schema.field(i), pa.array(out, part.schema.field(i).type))

    return df.mapInArrow(run, df.schema)
