"""Secret scan: fixed patterns, and strings in a sensitive context that dictionary-primed compression finds new.

A candidate is a long token after a sensitive word. Its marginal size is what zstandard needs for it when primed
with an identifier dictionary and the text around it, above the size of an empty frame. Words, names and repeats of
the surroundings compress to little; a random string costs nearly its entropy and is reported as ``novel``.

Defined results: a null text counts as empty; every match of a repeated row is reported per row; an empty table gives
an empty result; other columns are not read. Texts are read whole; work is linear in their length. An unbroken string with
sensitive words inside is judged twice at most: from the first and from the last of them on. ``reach`` (40 characters from a sensitive word
to a candidate) and ``window`` (400 characters of surroundings on each side) are parameters.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.spans import Span, Taken, digest, joined

KINDS = ("assign", "access", "hex", "novel")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Words that make what follows them sensitive.
SENSITIVE = re.compile(
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth(?:orization|_key)?|bearer|"
    r"credentials?|signature|session[ _-]?id|cookie|client[ _-]?id|webhook|seed phrase|encryption key)s?(?:\b|(?=_)|(?=(?-i:[A-Z])))", re.I | re.A)
LEAST = 12
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{LEAST},}}")
NAME = re.compile(r"[A-Za-z0-9_.-]*=+")
#: One linear test for whole batches; texts without a hit are clean.
SCREEN = r"(?i:pass|pwd|secret|token|api.?key|access.?key|private.?key|auth|bearer|credential|signature|session|cookie|client|webhook|seed phrase|encryption key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
#: What identifiers are made of; the raw dictionary of every compression.
IDENTIFIERS = (
    "0123456789 get set is has new old add remove update delete create read write open close start stop run init config default value name type "
    "index count size length list array map string number object class function method return import export public private static "
    "const var let self this super async await true false null none error exception message request response header body status "
    "user admin login logout account password passwd secret token api key access private auth authorization bearer client server "
    "example test sample demo placeholder changeme your_api_key your-token-here xxxxxxxx 00000000 12345678 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 http https www com org net io github localhost settings environment variable process env "
    "path file directory home usr local bin lib etc tmp var log json yaml xml html css script style module package version release "
    "account service database specification implementation representation recommendation information application authentication authorization "
    "administration documentation configuration initialization serialization validation verification notification transaction communication "
    "infrastructure architecture environment management development deployment requirement certificate encryption decryption permission "
    "credentials registration organization distribution subscription expiration classification identification generation replacement "
    "understanding relationship responsibility availability compatibility vulnerability accessibility functionality opportunities "
    "automatically immediately successfully unfortunately respectively independently characteristics international professional traditional "
    "conversation conference experience performance difference reference interface resource the and for with from that which between through "
).lower().encode()

#: Where identifiers are put together: at changes of case, at digits and at separators.
SEAMS = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|[+/_=.~-]+")


def plain_words(value: str) -> bytes:
    """An identifier as the lower-case words it is put together from; random strings stay as random."""
    return (" " + SEAMS.sub(" ", value).lower() + " ").encode()


def marginal_bytes(candidate: bytes, context: bytes) -> int:
    """Bytes that ``candidate`` adds when its surroundings and common identifiers are known."""
    import zstandard

    known = zstandard.ZstdCompressionDict(IDENTIFIERS + context, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=15, dict_data=known, write_content_size=False).compress
    return len(pack(candidate)) - len(pack(b""))


def peer(value: str) -> str:
    """A random string with the same kinds of characters at the same places; the same one every time."""
    rng = random.Random(len(value))
    kind = {**dict.fromkeys(string.digits, string.digits), **dict.fromkeys(string.ascii_lowercase, string.ascii_lowercase),
            **dict.fromkeys(string.ascii_uppercase, string.ascii_uppercase)}
    return "".join(rng.choice(kind.get(c, c)) for c in value)


def novel(value: str, around: str, least: float) -> bool:
    """Whether the marginal size reaches ``least`` of the size. In long strings zstandard packs letters and digits into
    fewer bits, random or not; there a random string of the same kind is the measure."""
    words, known = plain_words(value), plain_words(around)
    size = marginal_bytes(words, known)
    return size >= least * len(words) or (len(words) > 40 and size >= least * marginal_bytes(plain_words(peer(value)), known))


def novel_spans(text: str, taken: list[Span], reach: int = 40, window: int = 400, least: float = 0.8) -> list[Span]:
    """Candidates within ``reach`` characters after a sensitive word whose marginal size is at least ``least`` of their
    size, primed with ``window`` characters on both sides. Candidates that a base span covers are left to it."""
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    ends = [b for _, b in runs]
    inside: dict[int, list[int]] = {}  # of the sensitive words in a run, the ends of the first and the last
    starts: dict[int, int] = {}  # where to judge, and up to where
    for word in SENSITIVE.finditer(text) if runs else ():
        for k in range(bisect_right(ends, word.end()), len(runs)):
            a, b = runs[k]
            if a > word.end() + reach:
                break
            if a < word.end():
                inside[k] = [inside.get(k, [word.end()])[0], word.end()]
            else:
                starts[a] = b
    for k, places in inside.items():
        for a in places:
            b = runs[k][1]
            name = NAME.match(text, a, b)  # the name may go on before the value: SECRET_KEY=...
            starts[name.end() if name and b - name.end() >= LEAST else a] = b
    found: list[Span] = []
    known = Taken(taken)
    done = 0  # what a found candidate covers is not judged again
    for a, b in sorted(starts.items()):
        if b - a < LEAST or a < done or known.touches(a, b):
            continue
        value = text[a:b]
        # a secret said twice is still one: its own repeats do not count as surroundings
        around = (text[max(0, a - window) : a] + " " + text[b : b + window]).replace(value, " ")
        if novel(value, around, least):
            found.append((a, 3, b))
            done = b
    return found


def base_spans(text: str) -> list[Span]:
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans`` of every text."""
    counts = [f"n_{k}" for k in KINDS]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in counts]
                          + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")])
    empty = digest("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            n = [[0] * len(texts) for _ in KINDS]
            shas, all_spans = [empty] * len(texts), [""] * len(texts)
            hit = pc.fill_null(pc.match_substring_regex(texts, SCREEN), False)
            for i in pc.indices_nonzero(hit).to_pylist():
                text = texts[i].as_py()
                base = base_spans(text)
                spans = base + novel_spans(text, base)
                for _, k, _ in spans:
                    n[k][i] += 1
                shas[i], all_spans[i] = digest(joined(base, KINDS)), joined(spans, KINDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(shas), pa.array(all_spans)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with secrets replaced in ``text_col``, and ``length_col`` (if there is one) set to the new length where
    something was replaced. Texts without secrets, and all other columns, stay as they are."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = [None] * len(texts)
        for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, SCREEN), False)).to_pylist():
            text = texts[i].as_py()
            base = base_spans(text)
            if spans := base + novel_spans(text, base):
                out[i] = redact(text, spans, mark)
        return pa.array(out, pa.string())

    made = docs.withColumn("_clean", clean(F.col(text_col)))
    made = made.withColumn(text_col, F.coalesce("_clean", text_col))
    if length_col and length_col in docs.columns:
        made = made.withColumn(length_col, F.when(F.col("_clean").isNotNull(), F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return made.drop("_clean")
