"""Personal data: overlapping candidates, scored by boosted trees, chosen by calibrated thresholds.

Generators with high recall propose spans of four kinds: the exact base patterns, and looser ones for e-mail
addresses with written-out signs, dotted quadruples and groups of digits. Trees use the
format of a candidate and what stands around it, but not the signs by which the base patterns know theirs. They are
fitted on a bounded sample of texts and a fixed set of made-up ones. Personal are base spans, as they are and put into
looser formats (written-out signs, no plus, other groups, shorter cards); not personal is what cannot be (no Luhn sum,
octets over 255, dates, parts of longer words). Looser candidates that are neither are not fitted: nobody knows
what they are. Calibration on a part left out gives probabilities, and each kind has its own threshold. Base spans are
always kept; others are added if they pass and overlap no base span of their kind.

Null is an empty text. Rows are kept one by one, whatever their id; extra columns are ignored or kept.
All patterns take time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscope.llm.boosting import BoostParams, Isotonic, Trees, fit_isotonic, fit_trees
from ledgerscope.llm.labelled import in_share
from ledgerscope.llm.text_bytes import by_block, byte_class, sums_by_text, texts_of

# The kinds and their patterns, written so that no text makes them slow.
KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGITS_AND_DOTS = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
DIGIT_GROUPS = re.compile(r"[0-9](?:[ -]?[0-9])*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser candidates.
SPELLED_MAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|@) ?[\w-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[\w-]{1,63}){1,5}",
    re.IGNORECASE,
)
LOOSE_NUMBER = re.compile(r"\(?[0-9][0-9 ().\-/]{5,28}+")
CUES = {
    "email": re.compile(r"mail|contact|write|reach", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|server|address|login", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|pay|account", re.IGNORECASE),
    "phone": re.compile(r"phone|tel|call|mobile|fax|reach", re.IGNORECASE),
}
SECRET_CUE = re.compile(r"token|password|key|version|isbn|\$|=", re.IGNORECASE)
# Shapes of dates, years and sums, and a sentence that ends within a written-out address.
DATED = re.compile(
    r"(?:1[0-9]|20)[0-9]{2} ?[-/.] ?(?:(?:1[0-9]|20)[0-9]{2}|[01]?[0-9] ?[-/.] ?[0-3]?[0-9])\b"
    r"|[0-3]?[0-9] ?[-/.] ?[0-3]?[0-9] ?[-/.] ?(?:1[0-9]|20)[0-9]{2}\b"
)
SENTENCE = re.compile(r"(?<! )\. ")
MARKED = byte_class((48, 57), (64, 64), (40, 40), (91, 91), (123, 123))  # digits, @ and opening brackets

Span = tuple[int, int, int]  # kind, start, end


@dataclass(frozen=True)
class PiiParams:
    sample_rows: int = 20_000  # bound of the sample of texts whose candidates are fitted
    thresholds: tuple[float, ...] = (0.9, 0.95, 0.95, 0.95)  # by kind
    context: int = 24  # characters looked at on either side
    of_text: int = 16  # bound of the fitted rows of one text, for either label
    fitted: int = 60_000  # bound of the fitted rows
    boost: BoostParams = field(default_factory=lambda: BoostParams(trees=40, depth=4, min_rows=4))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass their test."""
    out = [(0, *span) for span in _emails(text)]
    for m in DIGITS_AND_DOTS.finditer(text):
        if m[1] and all(map(_small, m[0].split("."))):
            out.append((1, *m.span()))
    for m in DIGIT_GROUPS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Base spans and looser ones, overlapping as they may."""
    out = set(base)
    if "@" in text or re.search(r"[(\[{]at[)\]}]", text, re.IGNORECASE):
        for m in SPELLED_MAIL.finditer(text):
            out.add((0, *m.span()))
            short = SPELLED_MAIL.fullmatch(SENTENCE.split(m[0])[0])
            if short:  # the next sentence may not be part of it
                out.add((0, m.start(), m.start() + short.end()))
    out |= {(1, *m.span()) for m in DIGITS_AND_DOTS.finditer(text) if m[1]}
    for m in LOOSE_NUMBER.finditer(text):
        found = m[0].rstrip(" ().-/")
        size = len(_digits(found))
        if 8 <= size <= 15:
            start = m.start() - (m.start() > 0 and text[m.start() - 1] == "+")
            out.add((3, start, m.start() + len(found)))
        if 13 <= size <= 19:
            out.add((2, m.start(), m.start() + len(found)))
    return sorted(out)


def span_features(text: str, span: Span, context: int) -> list[float]:
    kind, start, end = span
    found = text[start:end]
    before, after = text[max(0, start - context) : start], text[end : end + context]
    digits = _digits(found)
    parts = re.split(r"[^0-9A-Za-z]+", found)
    last, following = before[-1:] or " ", after[:1] or " "
    return [
        kind, end - start, len(digits), len(parts), max(map(len, parts)), min(map(len, parts)),
        found.count("."), found.count("-"), found.count(" "), found.count("(") + found.count("["),
        bool(SENTENCE.search(found)), bool(DATED.match(found)), len(parts[-1]), parts[-1].isalpha(), parts[0].isalpha(),
        13 <= len(digits) <= 19 and luhn(digits), kind == 1 and all(map(_small, found.split("."))),
        last.isalnum(), last.isspace(), last in ".-_/\\=#$\"'", following.isalnum(), following.isspace(),
        following in ".-_/\\=\"'", bool(CUES[KINDS[kind]].search(before)), bool(SECRET_CUE.search(before)),
        sum(c.isdigit() for c in before) / max(1, len(before)), sum(c.isdigit() for c in after) / max(1, len(after)),
    ]


def impossible(text: str, span: Span, base: set[Span]) -> bool:
    """Whether a looser candidate is clearly not personal."""
    kind, start, end = span
    found = text[start:end]
    last, following = text[max(0, start - 1) : start], text[end : end + 1]
    if kind == 0:
        final = re.split(r"[^0-9A-Za-z]+", found)[-1]
        return bool(SENTENCE.search(found)) or len(final) < 2 or any(c.isdigit() for c in final)
    if kind == 1 or (1, start, end) in base:
        return True
    if last.isalnum() or following.isalnum() or last in ("_", "$", "#") or following in ("_", "%"):
        return True
    if kind == 2:
        return not luhn(_digits(found))
    return bool(DATED.match(found)) or sum(len(p) == 1 for p in re.split("[^0-9]+", found)) > 3


def _regrouped(digits: str, sizes: list[int], sign: str) -> str:
    parts, at = [], 0
    for size in sizes:
        parts.append(digits[at : at + size])
        at += size
    return sign.join(p for p in [*parts, digits[at:]] if p)


def loosened(kind: int, found: str, rng: random.Random) -> str:
    """A base span put into a looser format."""
    digits = _digits(found)
    if kind == 0:
        local, domain = found.split("@", 1)
        at = rng.choice((" (at) ", "(at)", " [at] ", "[at]", " {at} ", " (AT) ", " @ "))
        return local + at + domain.replace(".", rng.choice((".", ".", " (dot) ", "(dot)", " [dot] ", "[dot]", "{dot}")))
    if kind == 2:
        if rng.random() < 0.6:
            start = digits[: rng.choice((12, 13, 14))]
            digits = next(start + c for c in "0123456789" if luhn(start + c))
        sizes = rng.choice(([4, 4, 4], [4, 6], [99], [99], [5, 5]))
        return _regrouped(digits, sizes, rng.choice((" ", "-", ".", "/")))
    if kind == 3:
        form = rng.randrange(7)
        local = digits[-10:]
        if form < 2 or len(local) < 10:
            return found[1:]
        if form == 2:
            return f"({local[:3]}) {local[3:6]}-{local[6:]}"
        if form == 3:
            return f"00{digits}"[:15]
        if form == 4:
            return f"0{local[:3]}/{local[3:]}"
        return _regrouped(local, rng.choice(([3, 3], [3, 3], [4, 3], [2, 2, 2, 2], [99])), rng.choice(("-", "-", " ", ".")))
    return found


def _made_up() -> list[tuple[str, bool]]:
    """Texts with base spans, and texts whose candidates are not personal; the same at every call."""
    rng = random.Random(9)

    def number(size: int) -> str:
        return str(rng.randrange(10 ** (size - 1), 10**size))

    out = []
    for _ in range(300):
        start = rng.choice("3456") + number(14)
        card = next(start + c for c in "0123456789" if luhn(start + c))
        host = rng.choice(("mail.example.com", "example.org", f"site{number(2)}.example.net", "uni.de", "a-b.co.uk"))
        mail = rng.choice(("ann", "joe.b", f"kim{number(3)}", "x_y", f"li.{number(2)}")) + "@" + host
        phone = f"+{rng.choice(('1', '44', '49', '33'))} ({number(3)}) {number(3)}-{number(4)}"
        for found, cues in (
            (mail, ("mail ", "write to ", "", "reach me at ", "contact: ", "she is ")),
            (phone, ("call ", "tel. ", "phone: ", "", "fax ", "he has ")),
            (card, ("card ", "visa: ", "pay with ", "", "account ", "it is ")),
        ):
            out.append((f"{rng.choice(('', 'please ', 'so then ', 'or '))}{rng.choice(cues)}{found}{rng.choice(('', ' please', '. Thanks', ', or so'))}", True))
        year = rng.randrange(1900, 2030)
        a, b = rng.randrange(1, 13), rng.randrange(10, 29)
        out += [
            (f"pages {year}-{year + rng.randrange(9)} (at) home", False),
            (f"on {year}-{a:02}-{b} and {b}.{a}.{year}", False),
            (f"we meet (at) noon. {rng.choice(('Then', 'It', 'We'))} go", False),
            (f"bought {a} @ {b}.50 each", False),
            (f"{rng.choice(('token', 'key', 'version', 'order no', 'id', 'build', 'row', 'isbn'))}{rng.choice((' ', '=', ': '))}{number(rng.randrange(8, 13))}", False),
            (f"sum of {number(3)} {number(3)} {number(3)}.{a:02} paid", False),
            (" ".join(number(1) for _ in range(9)), False),
            (f"x{number(9)}y and ${number(9)}", False),
        ]
    return out


def training_rows(text: str, params: PiiParams, clear: bool = False) -> tuple[list[list[float]], list[int]]:
    """Features and labels of what is known in a text; with ``clear`` no looser candidate is personal."""
    base = base_spans(text)
    accepted = set(base)
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    good: list[list[float]] = []
    for kind, start, end in rng.sample(base, min(len(base), params.of_text // 2)):
        good.append(span_features(text, (kind, start, end), params.context))
        before, after = text[max(0, start - 128) : start], text[end : end + 128]
        new = loosened(kind, text[start:end], rng)
        changed = f"{before}{new}{after}"
        a, b = len(before), len(before) + len(new)
        fits = [s for s in candidates(changed, base_spans(changed)) if s[0] == kind and a <= s[1] and s[2] == b]
        if fits:
            good.append(span_features(changed, min(fits, key=lambda s: s[1]), params.context))
    other = [s for s in candidates(text, base) if s not in accepted and (clear or impossible(text, s, accepted))]
    bad = [span_features(text, s, params.context) for s in rng.sample(other, min(len(other), params.of_text))]
    return good + bad, [1] * len(good) + [0] * len(bad)


@dataclass(frozen=True)
class PiiModel:
    trees: Trees
    calibration: Isotonic
    params: PiiParams

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Base spans and all spans of each text; all candidates are scored at once."""
        bases = [base_spans(t) for t in texts]
        offered = [candidates(t, b) for t, b in zip(texts, bases, strict=True)]
        extra = [
            (i, s)
            for i, (base, found) in enumerate(zip(map(set, bases), offered, strict=True))
            for s in found
            if s not in base
        ]
        chosen: list[list[Span]] = [list(b) for b in bases]
        covered: dict[tuple[int, int], bytearray] = {}  # characters in chosen spans, by text and kind
        if extra:
            rows = [span_features(texts[i], s, self.params.context) for i, s in extra]
            score = self.calibration(self.trees.score(np.array(rows, dtype=np.float32)))
            order = sorted(range(len(extra)), key=lambda k: (extra[k][0], -score[k], extra[k][1]))
            for k in order:
                i, (kind, start, end) = extra[k]
                if score[k] < self.params.thresholds[kind]:
                    continue
                if (i, kind) not in covered:
                    taken = covered[i, kind] = bytearray(len(texts[i]))
                    for other, a, b in bases[i]:
                        if other == kind:
                            taken[a:b] = b"\1" * (b - a)
                taken = covered[i, kind]
                if 1 not in taken[start:end]:
                    taken[start:end] = b"\1" * (end - start)
                    chosen[i].append((kind, start, end))
        return [(sorted(b), sorted(c)) for b, c in zip(bases, chosen, strict=True)]


def _marked_texts(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Rows that could hold anything, and their texts."""
    texts = texts_of(column)
    rows = np.flatnonzero(sums_by_text(MARKED[texts.data], texts.offsets))
    return rows, [texts.text(i) for i in rows.tolist()]


def fit_pii(docs: DataFrame, params: PiiParams = PiiParams()) -> PiiModel:
    """Trees and calibration from what is known in a bounded sample of ``docs(doc_id, text)``."""

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        features, labels = [], []
        for text in _marked_texts(block.column("text"))[1]:
            x, y = training_rows(text, params)
            features += [np.array(row, np.float32).tolist() for row in x]
            labels += y
        arrays = [pa.array(labels, pa.int32()), pa.array(features, pa.list_(pa.float32()))]
        return pa.RecordBatch.from_arrays(arrays, ["label", "x"])

    some = docs.where(F.col("text").isNotNull())
    row = F.xxhash64("doc_id", "text")
    total = some.agg(F.approx_count_distinct(row)).first()[0]  # rows repeated with id and text count once
    sample = some.where(in_share(row, params.sample_rows, total)).dropDuplicates(["doc_id", "text"])
    table = sample.mapInArrow(by_block("text", work), "label int, x array<float>").toArrow()
    width = len(span_features("a@b.c", (0, 0, 5), params.context))
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)
    y = table.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T[::-1], y))  # the same whatever order tasks end in
    order = order[np.linspace(0, len(y) - 1, min(len(y), params.fitted)).astype(int)]
    seeds = [training_rows(text, params, clear=not personal) for text, personal in _made_up()]
    x = np.concatenate([x[order], np.array([row for rows, _ in seeds for row in rows], np.float32)])
    y = np.concatenate([y[order], [label for _, labels in seeds for label in labels]])
    order = np.lexsort((*x.T[::-1], y))
    x, y = x[order], y[order]
    apart = np.arange(len(y)) % 4 == 3
    trees = fit_trees(x[~apart], y[~apart], params.boost)
    return PiiModel(trees, fit_isotonic(trees.score(x[apart]), y[apart]), params)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_NOTHING = hashlib.sha256(b"").hexdigest()


def personal_data(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(fit_pii(docs, params))

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        n = block.num_rows
        counts = np.zeros((len(KINDS), n), np.int64)
        digests, spans = [_NOTHING] * n, [""] * n
        rows, texts = _marked_texts(block.column("text"))
        for i, (base, every) in zip(rows.tolist(), sent.value.spans(texts), strict=True):
            for kind, _, _ in base:
                counts[kind, i] += 1
            digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
            spans[i] = _joined(every)
        return pa.RecordBatch.from_arrays(
            [block.column("doc_id"), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )

    return docs.mapInArrow(
        by_block("text", work),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def redact(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind, as in ``<email>``."""
    at = docs.columns.index("text")
    model = fit_pii(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), params)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(block: pa.RecordBatch) -> pa.RecordBatch:
        rows, texts = _marked_texts(block.column("text"))
        new = block.column(at).to_pylist()
        for i, text, (_, spans) in zip(rows.tolist(), texts, sent.value.spans(texts), strict=True):
            if spans:
                new[i] = redacted(text, spans)
        arrays = list(block.columns)
        arrays[at] = pa.array(new, arrays[at].type)
        return pa.RecordBatch.from_arrays(arrays, block.schema.names)

    return docs.mapInArrow(by_block("text", work), docs.schema)


def redacted(text: str, spans: list[Span]) -> str:
    """Overlapping spans become one, named after the one that starts first."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= done:
            out += [text[done:start], f"<{KINDS[kind]}>"]
        done = max(done, end)
    return "".join(out) + text[done:]
