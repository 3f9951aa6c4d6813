"""Secret scan: fixed credential patterns plus sliding-window Shannon entropy over candidate strings.

A candidate is a run of ``MIN_CANDIDATE`` or more characters of ``[A-Za-z0-9+/_=-]`` that mixes letters and digits. Its
character class (hex, alnum or base64, the smallest that holds it) sets the entropy in bits a character that a window
must reach; the window's counts and its sum of c*log2(c) move by one character in and one out. Windows that reach it are
joined to spans. The allow-list (shapes and exact strings) takes entropy spans away; spans inside a base span add
nothing and are left out. Base spans always stay.

Offsets are code points, end exclusive. A null text is empty; every row gives one row, repeated ids too; a null doc_id
stays null; very long texts are scanned whole; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.common import slices

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns; the shortest match (of group 2 for assign) that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
#: What a text must hold for its pattern to be tried at all (RE2, over whole batches).
MAY_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
MAY_HEX = r"[0-9a-f]{16}"
MIN_CANDIDATE = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MAY_CANDIDATE = r"[A-Za-z0-9+/_=-]{20}"
#: Bits a character that a window must reach, by class; digits alone or letters alone are never secrets.
WINDOW = 20
ENTROPY = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
HEX_CLASS = re.compile(r"[0-9a-fA-F]+")
ALNUM_CLASS = re.compile(r"[A-Za-z0-9]+")
#: Shapes that are not secrets: UUIDs, dates and version-like paths, rules of one repeated sign, placeholders.
ALLOWED_SHAPES = re.compile(r"(?i:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|.*(example|placeholder|xxxx|0123456789).*|"
                            r"\d{4}-\d\d-\d\d.*|[a-z0-9]+([-_/][a-z]+)+)")
GAIN = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def entropy_spans(candidate: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Joined windows of ``window`` characters with at least ``least`` bits a character, by incremental counts."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    ceiling = (math.log2(window) - least) * window + 1e-9
    for i, new in enumerate(candidate):
        c = counts.get(new, 0)
        total += GAIN[c + 1] - GAIN[c]
        counts[new] = c + 1
        if i >= window:
            old = candidate[i - window]
            c = counts[old]
            total += GAIN[c - 1] - GAIN[c]
            counts[old] = c - 1
        start = i - window + 1
        if start >= 0 and total <= ceiling:
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def char_class(s: str) -> str | None:
    letters, digits = any(c.isalpha() for c in s), any(c.isdigit() for c in s)
    if not (letters and digits):
        return None
    return "hex" if HEX_CLASS.fullmatch(s) else "alnum" if ALNUM_CLASS.fullmatch(s) else "base64"


def scan(text: str, assign: bool = True, access: bool = True, hexes: bool = True, candidates: bool = True,
         allowed: frozenset[str] = frozenset()) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret value) by start, then kind in the order of ``KINDS``."""
    found = []
    if assign:
        found += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if access:
        found += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if hexes:
        found += [("hex", *m.span(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    base = [(a, b) for _, a, b, _ in found]
    for m in CANDIDATE.finditer(text) if candidates else ():
        kind = char_class(m[0])
        if kind is None or m[0] in allowed or ALLOWED_SHAPES.fullmatch(m[0]):
            continue
        for a, b in entropy_spans(m[0], ENTROPY[kind]):
            a, b = m.start() + a, m.start() + b
            if not any(x <= a and b <= y for x, y in base):
                found.append(("entropy", a, b, a))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scanned(texts: pa.Array, allowed: frozenset[str] = frozenset()):
    """Spans of each text; a pattern is only tried on texts that can match it."""
    may = [pc.match_substring_regex(texts, MAY_ASSIGN), pc.match_substring(texts, "AKIA"),
           pc.match_substring_regex(texts, MAY_HEX), pc.match_substring_regex(texts, MAY_CANDIDATE)]
    for i, flags in enumerate(zip(*(m.to_pylist() for m in may))):
        yield scan(texts[i].as_py(), *flags, allowed=allowed) if any(flags) else []


def find_secrets(docs: DataFrame, allowed: frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) per row of ``docs`` (doc_id, text)."""
    def run(batches):
        for part in slices(batches):
            rows = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")}
            for found in scanned(part.column("text").fill_null(""), allowed):
                base = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found if k != "entropy")
                for kind in KINDS:
                    rows[f"n_{kind}"].append(sum(k == kind for k, *_ in found))
                rows["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                rows["spans"].append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in found))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id")] + [pa.array(v, pa.int64() if c.startswith("n_") else pa.string()) for c, v in rows.items()],
                names=["doc_id", *rows])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def redact(docs: DataFrame, mark: str = "[SECRET]", allowed: frozenset[str] = frozenset()) -> DataFrame:
    """``docs`` with each secret value replaced by ``mark`` and n_chars set anew where a text changed. Null texts stay."""
    names = docs.columns

    def clean(text: str, found) -> str:
        out, at = [], 0
        for a, b in sorted((value, end) for _, _, end, value in found):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join(out) + text[at:]

    def run(batches):
        for part in slices(batches):
            texts = part.column("text")
            filled = texts.fill_null("")
            new, counts = [], part.column("n_chars").to_pylist() if "n_chars" in names else None
            for i, found in enumerate(scanned(filled, allowed)):
                new.append(clean(filled[i].as_py(), found) if found else texts[i].as_py())
                if found and counts:
                    counts[i] = len(new[-1])
            columns = dict(zip(names, part.columns)) | {"text": pa.array(new, pa.string())}
            if counts is not None:
                columns["n_chars"] = pa.array(counts, part.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return docs.mapInArrow(run, docs.schema)
