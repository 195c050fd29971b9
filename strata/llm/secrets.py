"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

Base patterns give spans of three kinds (assign, access, hex). The method adds spans of kind
``novel``: in sensitive contexts (a credential word shortly before), every candidate string is
measured by its marginal compressed size - bytes of zstandard(context + candidate) less bytes of
zstandard(context), both primed with a dictionary of common identifiers and with the code around
it - and reported when it costs close to what random text of its alphabet would.

Defined cases: null and empty texts have no spans (the hash of the empty string); rows stay one to
one with the input; other columns are ignored; texts are scanned whole. Positions are code
points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
# a run shorter than the least length never holds a longer one, so the length can be in the pattern
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST_ASSIGN = 6

_WORD = ("passw", "secret", "token", "api_key", "apikey")
_CONTEXT = re.compile(r"(?:pass(?:word|wd|phrase)|secret|token|api[_-]?key|credential|private[_-]?key|bearer|auth(?:orization)?|signature)", re.A | re.I)
_CONTEXT_WORD = ("passw", "passp", "secret", "token", "api", "credential", "private", "bearer", "auth", "signature")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: identifiers and code shapes that are common around credentials and are themselves no secrets
DICTIONARY = (
    "password passwd secret token api_key apikey access_key secret_key client_secret private_key public_key credential "
    "authorization bearer signature username account session cookie header request response config environment variable "
    "getenv os.environ process.env export import from return function const static final string value default example "
    "placeholder changeme your_api_key_here YOUR_TOKEN_HERE xxxxxxxxxxxxxxxxxxxxxxxx ******** 0000000000000000 1234567890 "
    "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/= 0123456789abcdef http:// https:// localhost "
    "the and of to in is that for with this from which have their would there about other into more some than them "
)
REACH = 48  # code points between a credential word and its candidate
AROUND = 256  # code points of surrounding text that prime the dictionary
RATIO = 0.85  # least share of the alphabet's entropy that the marginal bytes must reach


class Novelty:
    """Marginal compressed size of a candidate against its context."""

    def __init__(self):
        import zstandard
        self.z = zstandard
        self.params = zstandard.ZstdCompressionParameters.from_level(19, window_log=14, write_content_size=0, write_checksum=0, write_dict_id=0)

    def share(self, before: str, candidate: str, after: str) -> float:
        """Marginal bits per character over the bits of a random character of its alphabet."""
        prime = (DICTIONARY + before + " " + after).encode("utf-8", "ignore")
        primed = self.z.ZstdCompressor(dict_data=self.z.ZstdCompressionDict(prime, dict_type=self.z.DICT_TYPE_RAWCONTENT), compression_params=self.params)
        context = before[-32:].encode("utf-8", "ignore")
        extra = len(primed.compress(context + candidate.encode())) - len(primed.compress(context))
        alphabet = 10 * any(c.isdigit() for c in candidate) + 26 * any("a" <= c <= "z" for c in candidate) + 26 * any("A" <= c <= "Z" for c in candidate)
        if not re.search(r"[g-zG-Z+/_=-]", candidate):
            alphabet = 16
        return 8 * extra / (len(candidate) * math.log2(max(alphabet, 2)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    low = text.lower()
    if any(w in low for w in _WORD):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible strings after a credential word, outside the base spans."""
    out, seen = [], set()
    low = text.lower()
    if not any(w in low for w in _CONTEXT_WORD):
        return out
    starts, reach = [s for s, _, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
    for word in _CONTEXT.finditer(text):
        for m in _CANDIDATE.finditer(text, word.end(), min(len(text), word.end() + REACH + 512)):
            a, b = m.span()
            if a - word.end() > REACH or "\n" in text[word.end():a]:
                break
            if a in seen or not re.search(r"[0-9]", m[0]) or not re.search(r"[A-Za-z]", m[0]):
                continue
            b = _CANDIDATE.match(text, a).end()  # the whole run, however long
            seen.add(a)
            before = bisect.bisect_left(starts, b)  # base spans that start before b; the furthest end of them
            if before and reach[before - 1] > a:
                continue
            if novelty.share(text[max(0, a - AROUND):a], text[a:b], text[b:b + AROUND]) >= RATIO:
                out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, mark: str = "[SECRET]",
         carry: bool = False) -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, n_novel, base_sha256, spans; with ``redact`` also
    the text with every span replaced by ``mark`` (null stays null), and with ``carry`` the
    whole input row as a struct ``row``."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + novel_spans(text or "", base, novelty))
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                values = [*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
                if redact:
                    values.append(_redacted(text, spans, mark))
                for r, v in zip(rows, values, strict=False):
                    r.append(v)
            types = [pa.int64()] * 4 + [pa.string(), pa.string()] + [pa.string()] * redact
            names = ["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"] + ["redacted"] * redact
            cols = [batch.column(0), *(pa.array(r, t) for r, t in zip(rows, types, strict=False)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, *names, *["row"] * carry])

    longs = [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex", "n_novel")]
    texts = [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans", *["redacted"] * redact)]
    row = [T.StructField("row", docs.schema["row"].dataType)] if carry else []
    return docs.mapInArrow(run, T.StructType([T.StructField(id_col, docs.schema["id"].dataType), *longs, *texts, *row]))


def _redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
