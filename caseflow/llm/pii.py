"""Personal data in text: patterns propose spans, checksums confirm them, context words weigh them.

Built-in functions only.  A span's place is found by cutting the text at the matches: the lengths
of the pieces and of the matches between them add up to code point positions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``pattern`` uses possessive or bounded repeats and a fence before its first repeat, so that the time stays
    linear in very long runs; a text without ``sign`` has no match.  ``prior`` is the score of a confirmed span, ``support`` is added when
    one of ``words`` stands in the ``reach`` code points before it.  Spans under ``least`` go.
    """

    name: str
    sign: str
    pattern: str
    words: tuple[str, ...]
    prior: float
    support: float
    least: float = 0.0


# The four base kinds.  \G lets a match begin where the one before it ended.
EMAIL = Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", ("mail", "contact", "write"), 0.9, 0.1)
IP = Kind("ip", ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ("ip", "host", "server", "address"), 0.6, 0.3)
CARD = Kind("card", "", r"[0-9](?:[\x20-]?[0-9])++", ("card", "visa", "credit", "payment"), 0.8, 0.2)
PHONE = Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]", ("phone", "tel", "call", "fax"), 0.7, 0.3)
# Added by the method: account numbers that pass the mod-97 check.  A match is the first four signs only, its group the longest
# rest that ends before a fence; the number may end at an earlier space, and another may begin inside the rest.
IBAN = Kind("iban", "", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))", ("iban", "account", "bank", "konto"), 0.8, 0.2, 0.5)
# Added by the method: bare numbers of 8 to 12 digits are of no one unless a word nearby says whose: without support they go.
NUMBER = Kind("number", "", r"(?<![A-Za-z0-9+.-])[0-9]{8,12}(?![A-Za-z0-9]|[.-][0-9])", ("account", "bank", "konto", "compte", "cuenta", "passport", "ssn", "customer", "client"), 0.3, 0.5, 0.5)
BASE = (EMAIL, IP, CARD, PHONE)
KINDS = (*BASE, IBAN, NUMBER)
REACH = 40
#: Signs of the shortest account number.
LEAST_SIGNS = 15
#: Matches that are placed together.
BLOCK = 256


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def mod97(match: Column) -> Column:
    """Remainder of an account number: the first four signs go to the end, letters count 10 to 35."""
    plain = F.replace(match, F.lit(" "))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    code = lambda c: F.ascii(c) - F.when(F.ascii(c) >= 65, 55).otherwise(48)
    step = lambda rest, c: ((rest * F.when(F.ascii(c) >= 65, 100).otherwise(10) + code(c)) % 97).cast("int")
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)))


def confirmed(kind: Kind, match: Column) -> Column:
    n = F.length(digits(match))
    if kind is IP:
        return match.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")
    if kind is CARD:
        return F.when(n.between(16, 19), F.call_function("luhn_check", digits(match))).otherwise(False)
    if kind is PHONE:
        return n.between(8, 15)
    return F.lit(True)


def accounts(placed: Column) -> Column:
    """The account numbers at the proposed starts: of the ends at a fence, the last one under which the checksum holds."""
    spaced, first = F.lit(" "), lambda m, n: F.substr(m["match"], F.lit(1), n)
    ends = lambda m: F.filter(
        F.sequence(F.lit(LEAST_SIGNS), F.length(m["match"])),
        lambda n: F.substr(m["match"], n + 1, F.lit(1)).isin("", " ") & (F.substr(m["match"], n, F.lit(1)) != spaced)
        & (F.length(F.replace(first(m, n), spaced)) >= LEAST_SIGNS) & (mod97(first(m, n)) == 1),
    )
    sized = F.transform(placed, lambda m: F.struct(m["start"].alias("start"), F.array_max(ends(m)).alias("size")))
    sure = F.filter(sized, lambda m: m["size"].isNotNull())
    return F.transform(sure, lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["size"]).alias("end")))


def apart(found: Column) -> Column:
    """Spans in order without those that begin inside one that stays."""
    overlaps = F.exists(F.zip_with(found, F.slice(found, F.lit(2), F.size(found)), lambda a, b: F.coalesce(b["start"] < a["end"], F.lit(False))), lambda x: x)
    first = F.struct(F.lit(0).alias("end"), F.slice(found, F.lit(1), F.lit(0)).alias("out"))
    add = lambda state, x: F.when(x["start"] < state["end"], state).otherwise(
        F.struct(x["end"].alias("end"), F.concat(state["out"], F.array(x)).alias("out"))
    )
    return F.when(overlaps, F.aggregate(found, first, add, lambda state: state["out"])).otherwise(found)


def context(kind: Kind) -> str:
    """One of the kind's words, at the begin of a word or of what is looked at."""
    return rf"(?i)(?:^|[^A-Za-z0-9])(?:{'|'.join(kind.words)})"


def score(kind: Kind, before: Column) -> Column:
    near = before.rlike(context(kind))
    return F.lit(kind.prior) + F.when(near, kind.support).otherwise(0.0)


def running(items: Column, size, out) -> Column:
    """Every item of ``items``, made by ``out`` from the item and the sum of the sizes before it."""
    first = F.struct(F.lit(0).alias("at"), F.transform(F.slice(items, 1, 0), lambda x: out(x, F.lit(0))).alias("out"))
    add = lambda state, x: F.struct(
        (state["at"] + size(x)).alias("at"), F.concat(state["out"], F.array(out(x, state["at"]))).alias("out")
    )
    return F.aggregate(items, first, add, lambda state: state["out"])


def _pair_size(pair: Column) -> Column:
    return F.length(pair["piece"]) + F.coalesce(F.length(pair["match"]), F.lit(0))


def _located(kind: Kind) -> Callable[[Column], Column]:
    """From a block of pairs to start and match, counted from the block's begin."""
    whole = lambda p: F.concat(p["match"], p["rest"]) if kind is IBAN else p["match"]
    return lambda block: running(block, _pair_size, lambda p, at: F.struct((at + F.length(p["piece"])).alias("start"), whole(p).alias("match")))


def _placed(name: str) -> Column:
    """start, end and match of every match, from the blocks of (piece before it, match)."""
    blocks, local = F.col(f"__blocks_{name}"), F.col(f"__local_{name}")
    sized = F.zip_with(
        local, blocks, lambda found, block: F.struct(found.alias("found"), F.aggregate(block, F.lit(0), lambda n, p: n + _pair_size(p)).alias("size"))
    )
    moved = running(
        sized, lambda b: b["size"],
        lambda b, at: F.transform(b["found"], lambda m: F.struct((at + m["start"]).alias("start"), (at + m["start"] + F.length(m["match"])).alias("end"), m["match"].alias("match"))),
    )
    return F.filter(F.flatten(moved), lambda m: m["match"].isNotNull())  # no match follows the last piece


def _sure(kind: Kind) -> Column:
    placed = F.col(f"__placed_{kind.name}")
    return accounts(placed) if kind is IBAN else F.filter(placed, lambda m: confirmed(kind, m["match"]))


def _scored(text: Column, kind: Kind) -> Column:
    before = lambda m: F.substr(text, F.greatest(m["start"] - REACH, F.lit(0)) + 1, F.least(m["start"], F.lit(REACH)))
    sure = F.col(f"__sure_{kind.name}")
    scored = F.transform(
        sure, lambda m: F.struct(F.lit(kind.name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), score(kind, before(m)).alias("score"))
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.coalesce(F.filter(scored, lambda m: m["score"] >= kind.least), none)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, spans): every confirmed span of every row, by kind as listed, then by start.

    A span is struct<kind, start, end, score> in code points, its end exclusive.  Base kinds are kept
    whatever their score; an added kind needs its least score.  NULL counts as the empty text and has
    no spans; a row that is there twice is answered twice; no rows give none.
    """
    # One step per select: what a later step uses more than once is computed once.
    value, names = F.col("__text"), [k.name for k in kinds]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumns({f"__matches_{k.name}": F.when(value.contains(k.sign), F.regexp_extract_all(value, F.lit(k.pattern), 0)) for k in kinds})
    rows = rows.withColumns({
        f"__pairs_{k.name}": F.when(
            F.size(f"__matches_{k.name}") > 0,
            F.arrays_zip(
                F.split(value, k.pattern, -1).alias("piece"), F.col(f"__matches_{k.name}").alias("match"),
                *([F.regexp_extract_all(value, F.lit(k.pattern), 1).alias("rest")] if k is IBAN else []),
            ),
        )
        for k in kinds
    })
    # Blocks, so that a text with very many matches costs no copy of all of them per match.
    rows = rows.withColumns({
        f"__blocks_{n}": F.when(F.col(f"__pairs_{n}").isNotNull(), F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(f"__pairs_{n}") / BLOCK).cast("int") - 1), lambda b: F.slice(f"__pairs_{n}", b * BLOCK + 1, F.lit(BLOCK))
        ))
        for n in names
    })
    rows = rows.withColumns({f"__local_{k.name}": F.transform(f"__blocks_{k.name}", _located(k)) for k in kinds})
    rows = rows.withColumns({f"__placed_{n}": _placed(n) for n in names})
    rows = rows.withColumns({f"__sure_{k.name}": _sure(k) for k in kinds})
    if IBAN in kinds:
        rows = rows.withColumn(f"__sure_{IBAN.name}", apart(F.col(f"__sure_{IBAN.name}")))
    return rows.select("doc_id", F.concat(*[_scored(value, k) for k in kinds]).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digest of the base kinds, all spans and their scores (kind:start:percent) as text, from the rows of ``find``."""
    of = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    return found.select(
        "doc_id",
        *[F.size(of(k.name)).cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(joined(of(*[k.name for k in BASE])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], F.round(s["score"] * 100).cast("int"))), ",").alias("scores"),
    )
