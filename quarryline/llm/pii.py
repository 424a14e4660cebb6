"""Personal data by weak supervision (operator 9).

Patterns propose spans. Labelers by pattern, checksum, gazetteer, context, boundary and shape vote on
each; expectation-maximisation over the counts of their vote patterns in the whole table
estimates how reliable each labeler is; the chances that follow train a logistic span
classifier. The base spans (email, ip, card, phone by their strict rules) stay whatever it says;
it decides on the rest. Null and empty texts have no spans. Texts are read whole. Repeated rows get equal
spans; of proposed spans that begin at one place the first kind's is taken. A table without any span, an empty one too, is
left as it is. Other columns than doc_id and text stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quarryline.llm import textkernel as K
from quarryline.llm.common import bounded_batches, written

KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "secret"]
EMAIL, IP, CARD, PHONE, SSN, IBAN, SECRET = range(len(KINDS))
LABELERS = ["pattern", "checksum", "gazetteer", "context", "boundary", "shape"]
ABSTAIN, NO, YES = 0, 1, 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit before rules out no match of these two: it would start there already.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = [
    (CARD, re.compile(r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![\w-])")),
    (PHONE, re.compile(r"(?<![\w+.-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20-]?|[0-9]{2,4}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\w-])")),
    (SSN, re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    (IBAN, re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")),
    (SECRET, re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)gh[pousr]_[A-Za-z0-9]{36}(?!\w)|(?<!\w)sk_live_[A-Za-z0-9]{16,}(?!\w)")),
    (SECRET, re.compile(r"(?i)(?<!\w)(?:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?[\"']?[^\s\"'=:]{8,}[\"']?")),
]

# What the gazetteers and the context labeler know: mail services and ends of host names, beginnings of card
# numbers, calling codes, private networks, and the lengths of account numbers by country.
_MAILERS = ("gmail.", "googlemail.", "yahoo.", "ymail.", "hotmail.", "outlook.", "live.", "msn.", "icloud.", "me.", "proton", "pm.", "aol.", "gmx.", "web.de", "t-online.", "orange.", "free.fr", "libero.", "mail", "zoho.", "fastmail.", "example.")
_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name io co me tv cc dev app ai ar at au be bg br by ca ch cl cn co cr cy cz de dk ec ee eg es eu fi fr gr hk hr hu id ie il in ir is it jp ke kr kz lt lu lv ma mt mx my ng nl "
    "no nz pe ph pk pl pt ro rs ru sa se sg si sk th tn tr tw ua uk us uy ve vn za".split()
)
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "64", "65", "35", "30", "36", "38", "39", "22", "23", "24", "25", "26", "27", "62", "50", "56", "57", "58", "67")
_CALLING = tuple(
    "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 22 23 24 25 26 290 291 297 298 299 "
    "350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 380 381 382 383 385 386 387 389 420 421 423 50 59 67 68 69 800 85 87 88 96 97 99".split()
)
_PRIVATE = ("10.", "127.", "192.168.", "169.254.", *(f"172.{i}." for i in range(16, 32)), *(f"100.{i}." for i in range(64, 128)))
_ACCOUNTS = dict(
    (x[:2], int(x[2:])) for x in (
        "AL28 AD24 AT20 AZ28 BH22 BY28 BE16 BA20 BR29 BG22 CR22 HR21 CY28 CZ24 DK18 DO28 EG29 SV28 EE20 FO18 FI18 FR27 GE22 DE22 GI23 GR27 GL18 GT28 HU28 IS26 IQ23 IE22 IL23 IT27 JO30 KZ20 XK20 KW30 LV21 LB28 LI21 LT20 LU20 "
        "MT31 MR27 MU30 MD24 MC27 ME22 NL18 MK19 NO15 PK24 PS29 PL28 PT25 QA29 RO24 LC32 SM27 SA24 RS22 SC31 SK24 SI19 ES24 SE24 CH21 TN24 TR26 UA29 AE23 GB22 VA22 VG24"
    ).split()
)
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_")
_FOR = re.compile(r"(?i)(?:e-?mail|mail|contact|phone|tel|call|mobile|fax|whatsapp|card|visa|mastercard|credit|debit|ip|address|host|server|login|ssn|social security|iban|account|password|passwd|pwd|token|secret|key)\W{0,3}(?:\w{1,12}\W{1,2})?$")
_AGAINST = re.compile(r"(?i)(?:version|release|build|isbn|issn|section|chapter|figure|table|page|order|invoice|ticket|item|part|no|id|rfc|doi|v)\W{0,3}$|[$€£#]\s?$")

#: What the span classifier sees: what the labelers saw, and of the text around a span and of its characters what no labeler votes on.
BITS = ["checksum_ok", "checksum_bad", "known", "for", "against", "boundary", "shape_odd", "assigned", "after_colon", "after_digit", "line_start", "quoted", "sentence_end", "separated", "letters", "long"]


@dataclass(frozen=True)
class Classifier:
    """A weight for each kind and each bit; a span is accepted if its weights add up to more than 0."""

    kinds: tuple[float, ...]
    bits: tuple[float, ...]

    def strength(self, kind: Column, bits: Column) -> Column:
        out = F.element_at(F.array(*[F.lit(w) for w in self.kinds]), kind + 1)
        for i, w in enumerate(self.bits):
            out = out + F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, w).otherwise(0.0)
        return out

    def accepts(self, kind: int, bits: int) -> bool:
        out = self.kinds[kind]
        for i, w in enumerate(self.bits):  # in the order of strength(), so that both round alike
            out = out + (w if bits >> i & 1 else 0.0)
        return out > 0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict rules, in order: leftmost and non-overlapping for each kind; failing matches are dropped."""
    out = []
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, EMAIL, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def _votes(text: str, start: int, kind: int, end: int, strict: bool) -> tuple[int, int]:
    """The labelers' votes as digits of base 3, and the features as bits."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    check = {
        EMAIL: lambda: YES if re.search(r"\.[A-Za-z]{2,24}$", span) else NO,
        IP: lambda: YES if strict else NO,
        CARD: lambda: YES if luhn(digits) else NO,
        PHONE: lambda: YES if 9 <= len(digits) <= 15 else NO,
        SSN: lambda: NO if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else YES,
        IBAN: lambda: YES if _iban_ok(span) else NO,
        SECRET: lambda: YES if digits and re.search(r"[A-Za-z]", span) else NO,
    }[kind]()
    known = {
        EMAIL: lambda: (host := span.rpartition("@")[2].lower()).startswith(_MAILERS) or host.rpartition(".")[2] in _DOMAINS,
        IP: lambda: span.startswith(_PRIVATE),
        CARD: lambda: digits.startswith(_ISSUERS),
        PHONE: lambda: digits.startswith(_CALLING) and span[0] == "+",
        IBAN: lambda: _ACCOUNTS.get(span[:2]) == len(span.replace(" ", "")),
        SECRET: lambda: span.startswith(_PREFIXES),
    }.get(kind, lambda: False)()
    lead = text[max(0, start - 32) : start]
    own = kind == SECRET and not span.startswith(_PREFIXES)  # names itself: password=...
    for_ = bool(own or _FOR.search(lead))
    against = not own and bool(_AGAINST.search(lead))
    before, behind = text[start - 1 : start], text[end : end + 2]
    clean = not (before.isalnum() or before in ("_", "-") or behind[:1].isalnum() or behind[:1] in ("_", "-") or (behind[:1] == "." and behind[1:].isdigit()))
    odd = len(set(digits)) <= 2 and kind in (CARD, PHONE, SSN, IBAN) or digits.startswith("1234567")
    votes = [
        YES if strict or kind in (SSN, IBAN, SECRET) else ABSTAIN, check, YES if known else ABSTAIN, NO if against else YES if for_ else ABSTAIN,
        YES if clean else NO, NO if odd else ABSTAIN,
    ]
    close = lead.rstrip(" \t")
    bits = [
        check == YES, check == NO, known, for_, against, clean, odd, own or kind in (EMAIL,), close[-1:] in (":", "="), close[-1:].isdigit(), not close or close[-1] == "\n",
        before in ("\"", "'", "(", "[", "<", "{"), behind[:1] in (".", ",", ";", "!", "?"), any(c in " -." for c in span.strip()), any(c.isalpha() for c in span), len(span) > 24,
    ]
    return sum(v * 3**i for i, v in enumerate(votes)), sum(int(b) << i for i, b in enumerate(bits))


def spans(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(start, kind, end, base, votes, bits) of base spans and of proposed ones that don't overlap any before them."""
    base = base_spans(text)
    out = [(s, k, e, True) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    loose = sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(_LOOSE) for m in p.finditer(text))
    last, at = 0, 0
    for start, _, kind, end in loose:
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if start >= last and not any(s < end and e > start for s, e in taken[at : at + 8]):
            out.append((start, kind, end, False))
            last = end
    return [(s, k, e, b, *_votes(text, s, k, e, b)) for s, k, e, b in sorted(out)]


_TRIGGER = np.zeros(256, dtype=bool)
_TRIGGER[[ord(c) for c in "@0123456789=:"]] = True
# Keys that may hold none of these characters.
_KEY = "AKIA|ASIA|gh[pousr]_|sk_live_"


def flagged(texts: pa.Array) -> list[int]:
    """The texts that hold a digit, an at sign, an equals sign, a colon or the prefix of a key: no other has a span."""
    data, at = K.raw(texts)
    hits = np.flatnonzero(_TRIGGER[data])
    keys = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _KEY), False).to_numpy(zero_copy_only=False))
    return np.union1d(np.searchsorted(at, hits, side="right") - 1, keys).astype(int).tolist()


SPAN = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType()),
    T.StructField("base", T.BooleanType()), T.StructField("votes", T.IntegerType()), T.StructField("bits", T.IntegerType()),
])
_NAMES = [f.name for f in SPAN.fields]
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()), ("bits", pa.int32())]))


@arrow_udf(T.ArrayType(SPAN))
def proposed(texts: pa.Array) -> pa.Array:
    out: list[list[dict]] = [[]] * len(texts)
    for i in flagged(texts):
        out[i] = [dict(zip(_NAMES, s, strict=True)) for s in spans(texts[i].as_py())]
    return pa.array(out, type=_ARROW)


def masker(model: Classifier):
    """An expression on the text: its spans replaced by their kinds in brackets; overlapping ones by the first."""

    @arrow_udf(T.StringType())
    def masked(texts: pa.Array) -> pa.Array:
        hit = flagged(texts)
        if not hit:
            return texts
        new = []
        for i in hit:
            text, parts, last = texts[i].as_py(), [], 0
            for start, kind, end, base, _, bits in spans(text):
                if base or model.accepts(kind, bits):
                    if start >= last:
                        parts += [text[last:start], f"[{KINDS[kind].upper()}]"]
                    last = max(last, end)
            new.append("".join(parts) + text[last:])
        mask = np.zeros(len(texts), dtype=bool)
        mask[hit] = True
        return pc.replace_with_mask(texts, pa.array(mask), pa.array(new, type=texts.type))

    return masked


def reliabilities(kind: np.ndarray, votes: np.ndarray, count: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The chance of personal data for each row (kind, votes, count), by EM.

    Each labeler has a chance of each vote given the truth, the same for all kinds; each kind a share of truth of its own.
    The first guess is the votes' balance; one imagined row for each outcome keeps all chances above 0.
    """
    v = (votes[:, None] // 3 ** np.arange(len(LABELERS))) % 3
    yes, no = (v == YES).sum(axis=1), (v == NO).sum(axis=1)
    p = (yes + 0.5) / (yes + no + 1)
    for _ in range(rounds):
        share = np.array([((p * count)[kind == k].sum() + 1) / (count[kind == k].sum() + 2) for k in range(len(KINDS))])
        log = np.log(share[kind]), np.log(1 - share[kind])
        for j in range(len(LABELERS)):
            for side, w in enumerate((p * count, (1 - p) * count)):
                # a labeler is taken to be right more often than wrong before any vote is seen
                seen = np.bincount(v[:, j], weights=w, minlength=3) + (np.array([1, 1, 3]) if side == 0 else np.array([1, 3, 1]))
                log[side][:] = log[side] + np.log(seen / seen.sum())[v[:, j]]
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        if np.abs(new - p).max() < 1e-7:
            break
        p = new
    return p


def classifier(kind: np.ndarray, bits: np.ndarray, chance: np.ndarray, count: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights of kinds and bits (last: every kind) fitted to the chances by Newton steps."""
    x = _inputs(kind, bits)
    w = np.zeros(x.shape[1])
    total = max(count.sum(), 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (count * (chance - q)) / total - ridge * w / 10
        curve = (x * (count * np.maximum(q * (1 - q), 1e-4))[:, None]).T @ x / total + ridge / 10 * np.eye(len(w))
        step = np.clip(np.linalg.solve(curve, slope), -2, 2)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _inputs(kind: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.column_stack([kind[:, None] == np.arange(len(KINDS)), (bits[:, None] >> np.arange(len(BITS))) & 1]).astype(np.float64)


def fitted(found: DataFrame) -> Classifier:
    """The span classifier of a table; found has a column spans of proposed()."""
    # one row for each kind, vote pattern and bits: as many as the patterns allow, however large the table
    seen = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.bits").count().toPandas().sort_values(["kind", "votes", "bits"])
    if not len(seen):
        return Classifier((-1.0,) * len(KINDS), (0.0,) * len(BITS))
    kind, votes, bits, count = (seen[c].to_numpy(np.int64) for c in ("kind", "votes", "bits", "count"))
    w = classifier(kind, bits, reliabilities(kind, votes, count), count).tolist()
    return Classifier(tuple(w[: len(KINDS)]), tuple(w[len(KINDS) :]))


def _digest(s: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined in its order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256, spans and their number, a row for each row of documents."""
    found = written(bounded_batches(documents).select("doc_id", proposed("text").alias("spans")), "spans")
    model = fitted(found)
    base = F.filter("spans", lambda s: s["base"])

    def of(i: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    every = F.filter("spans", lambda s: s["base"] | (model.strength(s["kind"], s["bits"]) > 0))
    return found.select(
        "doc_id", *[of(i) for i in range(4)],
        F.sha2(_digest(base), 256).alias("base_sha256"), _digest(every).alias("spans"), F.size(every).cast("long").alias("n_spans"),
    )


def without_personal_data(documents: DataFrame) -> DataFrame:
    """documents with their spans masked in text; n_chars, if there, becomes the new length."""
    model = fitted(bounded_batches(documents).select(proposed("text").alias("spans")))
    out = documents.withColumn("text", masker(model)("text"))
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else out
