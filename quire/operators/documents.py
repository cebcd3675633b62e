"""Per-document operators that need Python: normal forms, packing, redaction, hashing embedder, greedy dedup."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import PII

# Labels before a name, and words that never continue one.
NAME_LABELS = (
    r"Name|Full[ ]Name|First[ ]Name|Last[ ]Name|Patient|Patient[ ]Name|Holder|Card[ ]?holder|Account[ ]Holder|Policy[ ]?holder|Insured|Beneficiary|Nominee|"
    r"Applicant|Employee|Customer|Client|Guardian|Father(?:'s[ ]Name)?|Mother(?:'s[ ]Name)?|Spouse|Signatory|Authorised[ ]Signatory"
)
NAME_STOPS = (
    r"Name|Full|First|Last|Patient|Holder|Card|Account|Policy|Insured|Beneficiary|Nominee|Applicant|Employee|Customer|Client|Guardian|Father|Mother|Spouse|"
    r"Signatory|Authorised|Mr|Mrs|Ms|Miss|Dr|Prof|SSN|DOB|ID|No|Date"
)
PERSON = rf"[A-Z][A-Za-z'’.\-]+(?:[ ]+(?!(?:{NAME_STOPS})\b)[A-Z][A-Za-z'’.\-]+){{0,3}}"
ACCOUNT = r"(?i)(?:bank\s+a/?c|account|acct|a/c)\s*(?:number|no\.?|#|num)?\s*[:\-#]?\s*([0-9][0-9\- ]{4,22}[0-9])"
SWIFT = r"(?i:swift|bic)(?:\s*code)?\s*[:\-#]?\s*([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"


def nfkc(text: str | None) -> str | None:
    """NFKC form without control, format and other category C characters, newline and tab kept."""
    if text is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFKC", text) if c in "\n\t" or unicodedata.category(c)[0] != "C")


def luhn(digits: str) -> bool:
    if not 13 <= len(digits) <= 19:
        return False
    doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


class Redactor:
    """Replaces PII by numbered placeholders; one value keeps one placeholder throughout a text."""

    def __init__(self, extra: tuple[tuple[str, str], ...] = (), kinds: set[str] | None = None):
        on = lambda k: kinds is None or k in kinds
        self.rules = [(k, re.compile(p), 0) for k, p in PII.items() if on(k)]
        if on("person"):
            self.rules += [("person", re.compile(rf"(?:{NAME_LABELS})\s*[:\-–]\s*({PERSON})"), 1), ("person", re.compile(rf"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+({PERSON})"), 1)]
        if on("account"):
            self.rules.append(("account", re.compile(ACCOUNT), 1))
        if on("swift_bic"):
            self.rules.append(("swift_bic", re.compile(SWIFT), 1))
        for kind, term in sorted(extra, key=lambda t: -len(t[1])):
            if len(term) >= 3 and on(kind):
                self.rules.append((kind, re.compile(rf"\b{re.escape(term)}\b", re.I), 0))

    @staticmethod
    def real(kind: str, value: str) -> bool:
        digits = re.sub(r"\D", "", value)
        return {"credit_card": luhn(digits), "person": len(value) >= 3, "account": len(digits) >= 5}.get(kind, True)

    def __call__(self, text: str | None) -> tuple[str | None, dict[str, str]]:
        """The text and what each placeholder stands for."""
        given: dict[str, str] = {}
        count: dict[str, int] = {}

        def swap(m: re.Match, kind: str, group: int) -> str:
            value = m[group]
            if not self.real(kind, value):
                return m[0]
            if value not in given:
                count[kind] = count.get(kind, 0) + 1
                given[value] = f"[{kind.upper()}_{count[kind]}]"
            a, b = m.start(group) - m.start(), m.end(group) - m.start()
            return m[0][:a] + given[value] + m[0][b:]

        for kind, pattern, group in self.rules:
            text = pattern.sub(lambda m, k=kind, g=group: swap(m, k, g), text) if text else text
        return text, {p: v for v, p in given.items()}


def restore(text: str | None, mapping: dict[str, str]) -> str | None:
    """Placeholders back to values; unknown placeholders stay."""
    return text if not text else re.sub(r"\[[A-Z_0-9]+_\d+\]", lambda m: mapping.get(m[0], m[0]), text)


def redact(docs: DataFrame, key: str, column: str, extra: tuple[tuple[str, str], ...] = (), kinds: set[str] | None = None) -> DataFrame:
    """(key, text, mapping, counts by kind) of each row."""
    redactor, types = Redactor(extra, kinds), dict(docs.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = [redactor(t) for t in pdf[column]]
            tally = [pd.Series([p[1:].rsplit("_", 1)[0].lower() for p in m]).value_counts().to_dict() if m else {} for _, m in done]
            yield pd.DataFrame({key: pdf[key], "text": [t for t, _ in done], "mapping": [m for _, m in done], "counts": tally})

    return docs.select(key, column).mapInPandas(run, f"{key} {types[key]}, text string, mapping map<string,string>, counts map<string,long>")


def hash_embedding(text: str | None, dim: int = 384) -> np.ndarray:
    """Signed feature hashing of words of two or more letters or digits, scaled to length one."""
    out = np.zeros(dim)
    for w in re.findall(r"[^\W_]{2,}", (text or "").lower()):
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "little") % dim] += 1 if h[4] & 1 else -1
    return out / (np.linalg.norm(out) or 1.0)


def embed(docs: DataFrame, key: str, column: str, dim: int = 384) -> DataFrame:
    types = dict(docs.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "vec": [hash_embedding(t, dim).astype("float32").tolist() for t in pdf[column]]})

    return docs.select(key, column).mapInPandas(run, f"{key} {types[key]}, vec array<float>")


def cut(block: str, start: int, target: int, overlap: int, sentences: bool = False) -> list[tuple[str, int, int]]:
    """Windows over one long block; with ``sentences`` they end at one where the last 40 % holds an end."""
    out, at = [], 0
    while True:
        end = min(len(block), at + target)
        if sentences and end < len(block):
            stop = max(block.rfind(mark, at + int(target * 0.6), end) + len(mark) for mark in (". ", "! ", "? ", ".\n", "; "))
            end = stop if stop > at + int(target * 0.6) else end
        out.append((block[at:end], start + at, start + end))
        if end >= len(block):
            return out
        at = max(at + 1, end - overlap)


def pack(page: str, target: int = 1000, overlap: int = 150, limit: int | None = None, sentences: bool = False) -> list[tuple[str, int, int]]:
    """(text, start, end) of a page's chunks: whole blocks packed up to ``target``, longer ones in windows.

    Offsets count in the page with its blocks joined by single blanks.  A chunk starts with the block
    before it when that is no longer than ``overlap`` and both fit.
    """
    blocks = [" ".join(b.split()) for b in re.split(r"\n[ \t]*\n+", page or "")]
    blocks = [b for b in blocks if b]
    starts = np.cumsum([0, *(len(b) + 1 for b in blocks)]).tolist()
    if not blocks:
        return []
    if starts[-1] - 1 <= target:
        return [(" ".join(blocks), 0, starts[-1] - 1)]
    out: list[tuple[str, int, int]] = []
    held: list[int] = []

    def close() -> None:
        if held:
            out.append((" ".join(blocks[i] for i in held), starts[held[0]], starts[held[-1]] + len(blocks[held[-1]])))

    for i, block in enumerate(blocks):
        width = sum(len(blocks[j]) + 1 for j in held)
        if len(block) > target:
            close()
            held = []
            out += cut(block, starts[i], target, overlap, sentences)
        elif held and width + len(block) > target:
            close()
            last = held[-1]
            held = [last, i] if 0 < len(blocks[last]) <= overlap and len(blocks[last]) + 1 + len(block) <= target else [i]
        else:
            held.append(i)
    close()
    return out if limit is None else out[:limit]


def shingles(text: str, n: int = 3) -> frozenset[tuple[str, ...]]:
    w = re.findall(r"[a-z0-9]+", text.lower())
    return frozenset([tuple(w)] if 0 < len(w) < n else (tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else [])


def keep_first(texts: list[str], threshold: float = 0.9) -> list[int]:
    """Places of texts unlike all kept before: Jaccard of word trigrams below ``threshold``; empty equals empty."""
    kept: list[tuple[int, frozenset]] = []
    for i, t in enumerate(texts):
        s = shingles(t)
        if not any((s == k) if not (s or k) else len(s & k) / len(s | k) >= threshold for _, k in kept):
            kept.append((i, s))
    return [i for i, _ in kept]


def chunks(pages: DataFrame, key: str, column: str, target: int = 1000, overlap: int = 150, threshold: float | None = 0.9, limit: int | None = None, normal: bool = True) -> DataFrame:
    """(key, idx, start, end, text): normalised, packed, and near repeats within the document dropped; without ``normal`` the text is taken as it is."""
    types = dict(pages.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, page in zip(pdf[key], pdf[column]):
                found = pack((nfkc(page) if normal else page) or "", target, overlap, limit)
                for idx in keep_first([c[0] for c in found], threshold) if threshold is not None else range(len(found)):
                    text, start, end = found[idx]
                    rows.append((k, idx, start, end, text))
            yield pd.DataFrame(rows, columns=[key, "idx", "start", "end", "text"])

    return pages.select(key, column).mapInPandas(run, f"{key} {types[key]}, idx int, start int, end int, text string")


def normalise(docs: DataFrame, key: str, column: str) -> DataFrame:
    types = dict(docs.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "text": [nfkc(t) for t in pdf[column]]})

    return docs.select(key, column).mapInPandas(run, f"{key} {types[key]}, text string")
