"""Operator 2: personal data by candidate generators and gradient-boosted trees.

Base spans come from four strict formats with checks (address octets, Luhn, digit counts) and always stay. High-recall
generators propose further, overlapping spans: telephone numbers without a plus, cards grouped by other marks, written
out mail addresses, defanged and version-6 addresses. Boosted trees score each proposal by its format and its context;
of overlapping ones the best above the calibrated threshold is added.

The trees learn from base spans: in a bounded sample of texts (``sample_docs``) each is rewritten in looser formats as a
positive, in a context of the sample. Negatives are decoys: dates, amounts, versions, codes, numbers without a cue, and
prose made of the sample's words. What is proposed in the sample itself has no label and is not learned from. Rows are
dealt into three folds: trees, calibration, and one threshold for each kind.

Whole texts are searched, in time that grows with their length: base formats are found from their rarest mark (at sign,
dots between digits, plus) outwards, and every loose pattern has bounded parts.

Cases: a null text is empty and has no span. Of overlapping proposals with equal scores the first by text, kind, start and end is added. Repeated rows get equal results. Empty tables give empty results. Extra
columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisite.llm.boost import BoostedTrees
from evisite.llm.common import byte_slices, fresh, low_hash, tidy

BYTES = 1_000_000  # of texts searched at once
KINDS = ["email", "ip", "card", "phone"]
LOCAL = string.ascii_letters + string.digits + "._%+-"
HEADS = frozenset(LOCAL)
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9][0-9.]*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Proposals beyond the base formats; every repetition is bounded or runs over marks of its own.
NUMBERS = re.compile(r"[(0-9][0-9()._/:\x20-]*+")
LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z.+@-])(?:(?:00[\x20.-]?)?\(?[0-9]{2,4}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}|[0-9]{9,11})(?![0-9A-Za-z@])")
LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[._/:\x20-]{1,3}[0-9]{4,6}){2,4}(?![0-9A-Za-z])")
AT = re.compile(r"\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?|\x20at\x20", re.I)
SPELLED = r"(?:\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20|[(\[{]\.[)\]}])"
LOOSE_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:(?:{SPELLED}|\.)[A-Za-z0-9-]{{1,63}}){{1,8}}(?![A-Za-z0-9-])", re.I)
SPELLED_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{SPELLED}[A-Za-z0-9-]{{1,63}}){{1,8}}(?![A-Za-z0-9-])", re.I)
LOOSE_IP = re.compile(rf"(?<![0-9A-Za-z.:])[0-9]{{1,3}}(?:{SPELLED}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z])", re.I)
IP_V6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{4,45}(?![0-9A-Za-z:])")
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "uk", "us")
CUES = [
    ("mail", "e-mail", "email", "contact", "write", "correo", "courriel", "at"),
    ("ip", "host", "server", "address", "addr", "from", "login"),
    ("card", "visa", "credit", "debit", "mastercard", "carte", "karte", "tarjeta", "payment"),
    ("phone", "tel", "call", "fax", "mobile", "cell", "telefon", "tél", "teléfono", "whatsapp"),
]
OTHER_CUES = ("date", "on", "version", "v", "page", "pp", "isbn", "no", "nr", "id", "order", "price", "total", "section", "fig", "table", "from", "between")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict spans of the four kinds by start, then kind as listed; overlaps between kinds stay."""
    out = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        low = at + 1
        if start < at and (host := HOST.match(text, low)):
            low = host.end()
            out.append(("email", start, low))
        at = text.find("@", low)
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, k = [m.span() for m in re.finditer("[0-9]+", run.group())], 0
        while k < len(parts):
            n = 1
            while n < 4 and k + n < len(parts) and parts[k + n][0] == parts[k + n - 1][1] + 1:
                n += 1
            if n == 4:
                a, b = parts[k][0], parts[k + 3][1]
                octets = [p.lstrip("0") for p in run.group()[a:b].split(".")]
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in octets):
                    out.append(("ip", run.start() + a, run.start() + b))
            k += n
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Loose spans of high recall; they may overlap each other and base spans."""
    out = []
    for run in NUMBERS.finditer(text):
        if run.end() - run.start() >= 9:
            for kind, pattern in (("phone", LOOSE_PHONE), ("card", LOOSE_CARD)):
                out += [(kind, m.start(), m.end()) for m in pattern.finditer(text, *run.span())]
    spelled = "dot" in text.lower() or "[.]" in text or "(.)" in text or "{.}" in text
    if spelled:
        for m in LOOSE_IP.finditer(text):
            if all(int(p) <= 255 for p in re.findall("[0-9]+", m.group())):
                out.append(("ip", *m.span()))
    if text.count(":") >= 2:
        for m in IP_V6.finditer(text):
            if m.group().count(":") >= 2 and _is_v6(m.group()):
                out.append(("ip", *m.span()))
    for m in AT.finditer(text) if spelled or "@" in text or "at)" in text.lower() or "at]" in text.lower() or "at}" in text.lower() else ():
        if text[m.start() - 1 : m.start()] not in HEADS:
            continue
        low = max(0, m.start() - 65)
        start = low + len(text[low : m.start()].rstrip(LOCAL))
        if start == m.start() or m.start() - start > 64:
            continue
        host = (SPELLED_HOST if m.group().strip().lower() == "at" else LOOSE_HOST).match(text, m.end())
        if host:
            out.append(("email", start, host.end()))
    return out


def _is_v6(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return True


def traits(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a proposal."""
    s = text[a:b]
    digits = re.sub("[^0-9]", "", s)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    before, after = text[max(0, a - 40) : a], text[b : b + 12]
    words = re.findall(r"[^\W\d_]+", before.lower())[-3:]
    seps = re.sub("[0-9A-Za-z]", "", s)
    nums = [int(g) for g in re.findall("[0-9]+", s)[:4]]
    return [
        KINDS.index(kind),
        len(s),
        len(digits),
        len(groups),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        max(groups, default=0),
        len(set(seps)),
        seps.count("/"),
        seps.count("."),
        seps.count("-"),
        seps.count(":"),
        seps.count("("),
        luhn(digits) if digits else 0,
        all(n <= 255 for n in nums),
        any(1900 <= n <= 2100 for n in nums),
        len(groups) == 3 and sum(n <= 31 for n in nums) >= 2,
        s.count("at") + s.count("@"),
        s.count("dot"),
        sum(w in CUES[KINDS.index(kind)] for w in words),
        sum(w in OTHER_CUES for w in words),
        before.rstrip().endswith((":", "=")),
        before[-1:].isalnum() or before[-1:] in "$€£#_",
        after[:1].isalnum() or after[:1] in "%_",
        sum(c.isdigit() for c in before + after),
        sum(c in "([{" for c in s),
        kind == "email" and not re.split(AT, s, maxsplit=1)[0].isalpha(),
        kind == "email" and re.findall("[A-Za-z]+|[^A-Za-z]+", s)[-1].lower() in ENDINGS,
        "::" in s,
        len(seps) == 0,
    ]


def loosened(kind: str, s: str, rng: random.Random) -> str:
    """A base span in a format that the base patterns don't know."""
    digits = re.sub("[^0-9]", "", s)
    if kind == "email":
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" @ ", "."), (" (at) ", " (dot) ")])
        name, host = s.split("@", 1)
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return s if ":" in s else s.replace(".", rng.choice(["[.]", "(.)", " dot ", "[dot]", "(dot)"]))
    if kind == "card":
        sep = rng.choice([".", "/", "  ", " - ", "_"])
        return sep.join(digits[k : k + 4] for k in range(0, 16, 4))
    d = digits[-10:].rjust(10, "2")
    return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}) {} {}", "{}/{}-{}", "{}{}{}"]).format(d[:3], d[3:6], d[6:])


def decoy(rng: random.Random, words: list[str]) -> tuple[str, str]:
    """A number or a phrase that is no personal data, and words before it."""
    r = rng.randint
    w = lambda: rng.choice(words)
    forms = [
        lambda: (f"{r(1900, 2099)}-{r(1, 12):02}-{r(1, 28):02}", "date"),
        lambda: (f"{r(1, 28):02}/{r(1, 12):02}/{r(1900, 2099)}", "on"),
        lambda: (f"{r(1, 28):02}.{r(1, 12):02}.{r(1900, 2099)}", "date"),
        lambda: (f"{r(1900, 2099)}-{r(1900, 2099)}", "between"),
        lambda: (f"{r(1, 999)}.{r(100, 999)}.{r(100, 999)}", "total"),
        lambda: (f"{r(10, 999)} {r(100, 999)} {r(100, 999)}", "price"),
        lambda: (f"978-{r(0, 9)}-{r(100, 999)}-{r(10000, 99999)}-{r(0, 9)}", "ISBN"),
        lambda: (f"{r(10, 99)}-{r(100, 999)}", "section"),
        lambda: (f"{r(100, 999)}-{r(100, 999)}", "pp"),
        lambda: (f"{r(1000, 9999)} {r(1000, 9999)} {r(1000, 9999)}", "no"),
        lambda: (f"{r(1000, 9999)}-{r(1000, 9999)}-{r(1000, 9999)}-{r(1000, 9999)}", "order"),
        lambda: (f"{r(0, 23):02}:{r(0, 59):02}:{r(0, 59):02}:{r(0, 99):02}", "from"),
        lambda: ("look at the dot com", ""),
        lambda: (f"stay at home dot {r(1, 9)}", "we"),
        lambda: (f"{r(1, 9)} {r(10, 99)} {r(10, 99)} {r(10, 99)}", "table"),
        lambda: (f"{r(10**8, 10**11 - 1)}", rng.choice(["id", "order", "no", ""])),
        lambda: (f"{w()} at {w()} dot {w()}", ""),
        lambda: (f"{w()} at {w()} dot {w()} dot {w()}", ""),
        lambda: (f"{w()} @ {w()}.{w()}", ""),
        lambda: (f"{w()} (at) {w()}.{w().title()}", ""),
        lambda: (f"{r(1, 99)} dot {r(1, 99)} dot {r(1, 9)} dot {r(1, 9)}", "score"),
        lambda: (f"{r(0, 9)}::{r(0, 9)}", "ratio"),
    ]
    return rng.choice(forms)()


def examples(texts: list[str], seed: int = 13, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Training rows: loosened base spans and decoys in contexts of the sample."""
    rng, x, y = random.Random(seed), [], []
    contexts = [t for t in texts if len(t) > 80] or ["the word of and to in for on with by from that this was are it as an or be " * 4]
    words = [w for t in contexts for w in re.findall(r"[^\W\d_]+", t)]
    spans = [(k, t[a:b]) for t in texts for k, a, b in base_spans(t)]
    made = [("email", f"{rng.choice(['user', 'jo.doe', 'a_b', 'info', 'maria', 'smith'])}{rng.choice(['', '.', '_', '-'])}{rng.choice(['', n, 'x'])}".rstrip("._-") + f"@{rng.choice(words).lower() if n % 2 else 'mail' + str(n % 9)}.{rng.choice(['', 'example.'])}{rng.choice(ENDINGS)}") for n in range(80)]
    made = [m for m in made if m[1].isascii()] + [("ip", f"{rng.randint(1, 255)}.{n}.{n * 3}.{n * 5}") for n in range(1, 40)]
    made += [("ip", ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))) for _ in range(20)] + [("ip", f"{rng.randint(4096, 65535):x}:{rng.randint(256, 65535):x}::{rng.randint(1, 65535):x}") for _ in range(20)]
    made += [("card", c) for c in ("4111111111111111", "5500005555555559", "4012888888881881", "378282246310005")] * 8 + [("phone", f"+1 ({200 + n}) 555-{1000 + 77 * n}") for n in range(40)]

    def place(s: str, cue: str) -> tuple[str, int, int]:
        t = rng.choice(contexts)
        at = rng.randrange(30, max(31, len(t) - 40))
        at = t.find(" ", at) + 1 or at
        head = t[max(0, at - 60) : at] + (cue + rng.choice([" ", ": ", ". "]) if cue else "")
        return head + s + " " + t[at : at + 40], len(head), len(head) + len(s)

    def learn(text: str, a: int, b: int, label: int) -> None:
        for kind, p, q in proposals(text):
            if p < b and a < q:
                near = label and max(p, a) < min(q, b) and (min(q, b) - max(p, a)) >= 0.9 * (max(q, b) - min(p, a)) and kind == learn.kind
                x.append(traits(text, kind, p, q))
                y.append(int(bool(near)))

    by_kind = [[m for m in made if m[0] == k] + [s for s in spans if s[0] == k] for k in KINDS]
    for n in range(rounds):
        kind, s = rng.choice(by_kind[n % 4])
        learn.kind, loose = kind, loosened(kind, s, rng)
        sure = [*CUES[KINDS.index(kind)]]
        learn(*place(loose, rng.choice(sure if loose.isdigit() else [*sure, "", "", ""])), 1)
        s, cue = decoy(rng, words)
        learn.kind = None
        learn(*place(s, rng.choice([cue, cue, ""])), 0)
    return np.array(x, float), np.array(y, float)


def fit(docs: DataFrame, sample_docs: int = 300, window_chars: int = 20_000, text_col: str = "text") -> BoostedTrees:
    """Trees from a sample of at most ``sample_docs`` texts that hold a digit or an at sign, by a hash of the text.

    Of longer texts a window of ``window_chars`` characters at a hashed place is used.
    """
    text = F.col(text_col)
    start = F.pmod(F.xxhash64(F.lit(4), text), F.greatest(F.lit(1), F.length(text) - window_chars)).cast("int") + 1
    hashed = docs.filter(text.rlike("@|[0-9]{4}")).withColumn(h := fresh(docs, "h"), F.xxhash64(F.lit(3), text))
    hashes, total = hashed.select(h).distinct(), F.lit(docs.count())
    ends = lambda rows: rows.orderBy(h).limit(sample_docs).agg(F.max(h).alias("last"), F.count(F.lit(1)).alias("n")).first()  # noqa: E731  hashes travel, texts don't
    found = ends(hashes.filter(low_hash(F.col(h), 10 * sample_docs, total)))
    last = found.last if found.n == sample_docs else ends(hashes).last  # else few texts are searched
    rows = hashed.filter(F.col(h) <= F.lit(last)).select(F.col(h).alias("h"), text.substr(start, F.lit(window_chars)).alias("t")).dropDuplicates(["h"]).collect()
    x, y = examples([r.t for r in sorted(rows, key=lambda r: r.h)])
    return BoostedTrees().fit(x, y, x[:, 0].astype(int))


def _free(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether no interval of a sorted, non-overlapping list meets ``a`` to ``b``."""
    k = bisect.bisect_left(starts, b)
    return k == 0 or ends[k - 1] <= a


def find_spans(texts: list[str], model: BoostedTrees | None) -> list[tuple[list, list]]:
    """For each text its base spans and all spans."""
    out, rows, back, taken = [], [], [], []
    for n, t in enumerate(texts):
        base = base_spans(t)
        out.append((base, base))
        if model is None:
            continue
        starts, ends = [], []
        for _, a, b in base:
            if ends and a < ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        taken.append((starts, ends))
        for kind, a, b in proposals(t):
            if _free(starts, ends, a, b):
                rows.append(traits(t, kind, a, b))
                back.append((n, kind, a, b))
    if rows:
        p = model.predict(np.array(rows, float))
        chosen: dict[int, list] = {}
        for score, (n, kind, a, b) in sorted(zip(-p, back)):
            starts, ends = taken[n]
            if -score >= model.thresholds.get(KINDS.index(kind), 1.1) and _free(starts, ends, a, b):
                k = bisect.bisect_left(starts, a)
                starts.insert(k, a)
                ends.insert(k, b)
                chosen.setdefault(n, []).append((kind, a, b))
        for n, more in chosen.items():
            base = out[n][0]
            out[n] = (base, sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
    return out


def told(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, model: BoostedTrees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base counts by kind, a digest of the base spans, all spans, and the number of added ones."""

    def found(batches):
        for batch in batches:
            for some in byte_slices(batch, 1, BYTES):
                spans = find_spans([t or "" for t in some.column(1).to_pylist()], model)
                cols = [[sum(s[0] == k for s in base) for base, _ in spans] for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        *[pa.array(c, pa.int64()) for c in cols],
                        pa.array([hashlib.sha256(told(base).encode()).hexdigest() for base, _ in spans]),
                        pa.array([told(all_) for _, all_ in spans]),
                        pa.array([len(all_) - len(base) for base, all_ in spans], pa.int64()),
                    ],
                    names=[c.split()[0] for c in FOUND.split(", ")],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(found), FOUND)


def redacted(text: str, spans: list) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    parts, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, model: BoostedTrees | None, text_col: str = "text") -> DataFrame:
    """All rows and columns with the spans of the text replaced by their kinds; null texts stay null."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def cleaned(batches):
        for batch in batches:
            for some in byte_slices(batch, at, BYTES):
                texts = some.column(at).to_pylist()
                spans = find_spans([t or "" for t in texts], model)
                new = pa.array([None if t is None else redacted(t, s) for t, (_, s) in zip(texts, spans)], some.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([new if n == at else c for n, c in enumerate(some.columns)], schema=some.schema)

    return docs.mapInArrow(tidy(cleaned), docs.schema)
