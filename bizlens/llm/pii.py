"""Personal data replaced by keyed surrogates of the same type and form.

Detection finds e-mail addresses, phone numbers, IPv4 addresses, payment cards, US social
security numbers, credentials given as ``name = "value"`` and person names (after a form of
address, or a known first name before a capitalised word; later bare mentions of the
surname count too). Every entity has a kind and a canonical form, so all its spellings get
one surrogate, in every document (coreference).

A surrogate is drawn by a keyed hash of kind, canonical form and attempt: names keep gender,
script and case, numbers keep their separators and check digits, addresses stay valid.
Attempts are settled over the distinct entities of all documents: of several entities that
drew the same surrogate one keeps it, and none may draw a form that occurs as a real entity;
the others draw again until no collision is left (distinctness). Only entities past their
first attempt need a table; everything else is drawn where the text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from . import text as T
from .storage import materialise

#: Entities past their first attempt are broadcast up to this many, and joined beyond.
BROADCAST_MOST = 50_000

# Forms of address and common first names by gender.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"),
    "u": ("Dr", "Prof", "Professor"),
}
NAMES = {
    ("m", "latin"): ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Daniel", "Peter",
                     "Hans", "Klaus", "Jürgen", "Stefan", "Pierre", "Jacques", "Michel", "José", "Carlos", "Miguel"),
    ("f", "latin"): ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Karen", "Emily",
                     "Anna", "Ursula", "Sabine", "Petra", "Marie", "Claire", "Sophie", "María", "Carmen", "Lucía"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Сергей", "Дмитрий", "Алексей", "Николай", "Михаил", "Андрей"),
    ("f", "cyrillic"): ("Анна", "Мария", "Ольга", "Елена", "Наталья", "Татьяна", "Ирина", "Светлана"),
}
# Prefixes and lengths of the large card networks.
CARD_PREFIXES = (("4", 13), ("4", 16), ("4", 19), ("34", 15), ("37", 15), ("51", 16), ("52", 16), ("53", 16), ("54", 16),
                 ("55", 16), ("2221", 16), ("2720", 16), ("6011", 16), ("65", 16))
# Digits of the groups that cards are written in; cards in these forms come before all other numbers.
CARD_FORMS = {(13,), (15,), (16,), (19,), (4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 4, 4, 1), (4, 3, 3, 3)}

_SYLLABLES = {
    "latin": ("ba", "den", "fel", "gar", "hol", "kin", "lor", "mer", "nal", "pen", "ros", "sil", "tam", "vor", "wes", "zan"),
    "cyrillic": ("ба", "вер", "гол", "дан", "зор", "кал", "лен", "мир", "нов", "пет", "рос", "сим", "тар", "фед", "хол", "чер"),
}
_ENDINGS = {("m", "latin"): "o", ("f", "latin"): "a", ("u", "latin"): "e", ("l", "latin"): "er",
            ("m", "cyrillic"): "ий", ("f", "cyrillic"): "ия", ("u", "cyrillic"): "е", ("l", "cyrillic"): "ко"}

_GENDER = {n.casefold(): g for (g, _), names in NAMES.items() for n in names}
_TITLE_GENDER = {t.casefold(): g for g, ts in TITLES.items() for t in ts}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PARTS = (
    r"(?P<email>[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
    r"(?P<credential>(?i:(?<![A-Za-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"'])"
    r"[A-Za-z0-9_+/.=-]{12,}(?=[\"']))",
    rf"(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))",
    r"(?P<digits>(?<![\d.-])\d(?:[ -]?\d){12,})",
    r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))")
_TECHNICAL = re.compile("|".join(_PARTS))
_NO_CARD = re.compile("|".join(p for p in _PARTS if "<digits>" not in p))
_RUN = re.compile(r"\d(?:[ -]?\d)*")
_TRIGGER = re.compile(r"[@0-9]|=\s*[\"']|:\s*[\"']")
_TITLED = re.compile(r"(?<!\w)(?P<title>" + "|".join(sorted(_TITLE_GENDER, key=len, reverse=True)) + r")\.?[  ]"
                     r"(?P<name>[^\W\d_][\w'’-]*(?: [^\W\d_][\w'’-]*){0,2})", re.I)
_KNOWN = re.compile(r"(?<!\w)(?P<first>" + "|".join(sorted(_GENDER, key=len, reverse=True)) + r") (?P<last>[^\W\d_][\w'’-]+)", re.I)
_WORDS = tuple(n for names in (*TITLES.values(), *NAMES.values()) for n in names)
_WORDS += tuple(w.upper() for w in _WORDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def script(word: str) -> str:
    """Script of a name's first letter, as far as surrogates tell them apart."""
    c = ord(word[0])
    return "latin" if c < 0x250 else "cyrillic" if 0x400 <= c < 0x530 else "other"


def _capital(word: str) -> bool:
    return word[:1].isupper() or (script(word) == "other" and word[:1].isalpha())


def _is_card(digits: str) -> bool:
    return any(digits.startswith(p) and len(digits) == n for p, n in CARD_PREFIXES) and luhn(digits)


def _cards(text: str, groups: list[tuple[int, int]], forms: set | None) -> list[tuple[int, int]]:
    """(first group, last group + 1) of the cards in adjoining groups of digits, the longest of each start;
    ``forms`` restricts how their digits are grouped."""
    out, i = [], 0
    while i < len(groups):
        last, digits, sizes = 0, "", ()
        for j in range(i, len(groups)):
            digits += text[groups[j][0]:groups[j][1]]
            sizes += (groups[j][1] - groups[j][0],)
            if len(digits) > 19:
                break
            if (forms is None or sizes in forms) and _is_card(digits):
                last = j + 1
        if last:
            out.append((i, last))
        i = last or i + 1
    return out


def _groups(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in re.compile(r"\d+").finditer(text, start, end)]


def _numbers(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what begins in a run of digits over single spaces and hyphens: cards in
    a usual form, then everything else but cards, then cards in the groups that are left."""
    groups = _groups(text, start, end)
    cards = _cards(text, groups, CARD_FORMS)
    found = [("card", groups[i][0], groups[j - 1][1]) for i, j in cards]
    rest: list[list[tuple[int, int]]] = []
    for a, b in zip([0, *(j for _, j in cards)], [*(i for i, _ in cards), len(groups)]):
        limit, at = groups[b][0] if b < len(groups) else len(text), start
        rest.append([])
        for group in groups[a:b]:
            if group[0] < at:
                continue
            if m := _NO_CARD.match(text, group[0], limit):
                found.append((m.lastgroup, *m.span()))
                at = m.end()
                rest.append([])
            else:
                rest[-1].append(group)
    for left in rest:
        found += [("card", left[i][0], left[j - 1][1]) for i, j in _cards(text, left, None)]
    return sorted(found, key=lambda f: f[1])


def _technical(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of everything but names, in order."""
    at = 0
    while m := _TECHNICAL.search(text, at):
        at = m.end()
        if m.lastgroup == "digits":
            found = _numbers(text, *m.span())
            yield from found
            at = max([at, *(f[2] for f in found)])
            continue
        if m.lastgroup == "phone":  # the last groups may belong to a card behind it
            groups = _groups(text, m.start(), _RUN.match(text, _groups(text, m.start(), at)[-1][0]).end())
            for i, j in _cards(text, groups, CARD_FORMS):
                if groups[i][0] < at < groups[j - 1][1] and _RUN.fullmatch(text, groups[i][0], groups[j - 1][1]) and (
                        cut := _TECHNICAL.match(text, m.start(), groups[i][0])):
                    m, at = cut, cut.end()
                    break
        yield m.lastgroup, *m.span()


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities of a text, without overlaps, in order."""
    found = []
    if _TRIGGER.search(text):
        for kind, start, end in _technical(text):
            value = text[start:end]
            if kind == "email":
                start += len(value) - len(value.lstrip("._%+-"))
                canon = text[start:end].casefold()
                if canon.startswith("@"):
                    continue
            elif kind == "credential":
                start += max(value.rfind('"'), value.rfind("'")) + 1
                canon = text[start:end]
            elif kind == "ip":
                canon = value
            else:
                canon = re.sub(r"\D", "", value)
                if kind == "phone" and value.startswith("+"):
                    cc = re.match(r"\+\d{1,3}", value).end()
                    start, canon = start + cc, re.sub(r"\D", "", value[cc:])
            found.append((start, end, kind, canon))
    if any(w in text for w in _WORDS):
        found += _people(text, [(a, b) for a, b, _, _ in found])
    return sorted(found)


def _people(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    spans: dict[int, tuple[int, int, str, str]] = {}

    def add(start: int, word: str, kind: str) -> None:
        end = start + len(word)
        if start not in spans and not any(a < end and start < b for a, b in taken):
            spans[start] = (start, end, f"{kind}-{script(word)}", word.casefold())

    surnames = set()
    for m in _TITLED.finditer(text):
        if not _capital(m["title"]):
            continue
        gender, words, at = _TITLE_GENDER[m["title"].casefold()], [], m.start("name")
        for w in m["name"].split(" "):
            if not _capital(w):
                break
            words.append((at, w))
            at += len(w) + 1
        for i, (at, w) in enumerate(words):
            known = _GENDER.get(w.casefold())
            if i + 1 < len(words) or (known and len(words) == 1):
                add(at, w, "first." + (known or gender))
            else:
                add(at, w, "last")
                surnames.add(w)
    for m in _KNOWN.finditer(text):
        if _capital(m["first"]) and _capital(m["last"]):
            add(m.start("first"), m["first"], "first." + _GENDER[m["first"].casefold()])
            add(m.start("last"), m["last"], "last")
            surnames.add(m["last"])
    long = sorted((s for s in surnames if len(s) > 3), key=len, reverse=True)
    if long:
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, long)) + r")(?!\w)", text):
            add(m.start(), m.group(), "last")
    return list(spans.values())


class _Draw:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: object):
        self.seed = repr(parts).encode()
        self.key, self.turn, self.pool = key, 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = blake2b(self.seed + bytes([self.turn % 256, self.turn // 256]), key=self.key, digest_size=64).digest()
            self.turn += 1
        v, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return v % n


def _letters(text: str, draw: _Draw) -> str:
    """Every digit and Latin letter replaced by another of its class; other letters by Latin ones."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            x = chr(97 + draw.below(26))
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


@lru_cache(100_000)
def surrogate(kind: str, canon: str, attempt: int, key: bytes) -> str:
    """Canonical form of the surrogate."""
    draw = _Draw(key, kind, canon, attempt)
    if kind == "email":
        local, host = canon.rsplit("@", 1)
        label = _Draw(key, "host", host)
        top = host.rsplit(".", 1)[1]
        name = "".join(chr(97 + label.below(26)) for _ in range(8))
        return f"{_letters(local, draw)}@{name}.example.{top if top in ('com', 'net', 'org') else 'com'}"
    if kind == "credential":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon):
            return "".join(("0123456789abcdef" if canon == canon.lower() else "0123456789ABCDEF")[draw.below(16)] for _ in canon)
        return _letters(canon, draw)
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "card":
        prefix = max((p for p, n in CARD_PREFIXES if canon.startswith(p) and len(canon) == n), key=len)
        body = prefix + "".join(str(draw.below(10)) for _ in range(len(canon) - len(prefix) - 1))
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind in ("phone", "ssn"):
        return "".join(str(draw.below(10)) for _ in canon)
    part, alphabet = kind.split("-")
    if alphabet == "other":
        return "".join(chr(0x4E00 + draw.below(0x4000)) for _ in canon)
    gender = part[-1] if part.startswith("first") else "l"
    if gender in "mf" and attempt < 4:
        names = NAMES[gender, alphabet]
        return names[draw.below(len(names))].casefold()
    size = 2 + (len(canon) > 7) + min(3, attempt // 8)
    return "".join(_SYLLABLES[alphabet][draw.below(16)] for _ in range(size)) + _ENDINGS[gender, alphabet]


def render(surface: str, kind: str, drawn: str) -> str:
    """The surrogate in the form of the replaced text: its separators, or its case."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(drawn)
        return "".join(next(digits) if c.isdigit() else c for c in surface)
    if kind.startswith(("first", "last")):
        if surface.isupper() and len(surface) > 1:
            return drawn.upper()
        return drawn if surface.islower() else drawn[:1].upper() + drawn[1:]
    return drawn.upper() if kind == "email" and surface.isupper() else drawn


def spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, kind, canon): one row per entity; positions count characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *e) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t
                    for e in detect(t)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(),
                                                       pa.string()))], ["id", "start", "end", "kind", "canon"])

    kind = df.schema[id_col].dataType.simpleString()
    return (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(T.lean(run), f"id {kind}, start int, end int, kind string, canon string"))


def _drawn(key: bytes) -> Column:
    @F.udf("string")
    def draw(kind, canon, attempt):
        return surrogate(kind, canon, attempt, key)
    return draw("kind", "canon", "attempt")


def settle(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt) of the entities that had to draw again; ``entities`` are distinct."""
    entities = materialise(entities, "entities")
    state = materialise(entities.withColumn("attempt", F.lit(0)).withColumn("drawn", _drawn(key)), "drawn")
    while True:
        # first names of one script share one space whatever the gender
        space = F.regexp_replace("kind", r"^first\.[mfu]", "first")
        holder = state.groupBy(space.alias("space"), "drawn").agg(
            F.min(F.struct("attempt", "kind", "canon")).alias("holder"), F.count("*").alias("n"))
        real = entities.select(space.alias("space"), F.col("canon").alias("drawn")).distinct()
        clash = (holder.where("n > 1").select("space", "drawn", "holder")
                 .unionByName(holder.join(real, ["space", "drawn"], "left_semi")
                              .select("space", "drawn", F.lit(None).cast(holder.schema["holder"].dataType).alias("holder")))
                 .groupBy("space", "drawn").agg(F.min(F.col("holder").isNotNull()).alias("kept"), F.max("holder").alias("holder")))
        clash = materialise(clash, "clash")
        if clash.isEmpty():
            return state.where("attempt > 0").select("kind", "canon", "attempt")
        again = (state.withColumn("space", space).join(clash, ["space", "drawn"], "left")
                 .withColumn("lost", F.col("kept").isNotNull() & ~(F.col("kept") & (
                     F.struct("attempt", "kind", "canon") == F.col("holder")))))
        state = materialise(again.withColumn("attempt", F.col("attempt") + F.col("lost").cast("int"))
                            .select("kind", "canon", "attempt",
                                    F.when(F.col("lost"), _drawn(key)).otherwise(F.col("drawn")).alias("drawn")), "drawn")


ENTITY = Ty.StructType([Ty.StructField("kind", Ty.StringType()), Ty.StructField("start", Ty.IntegerType()),
                        Ty.StructField("end", Ty.IntegerType()), Ty.StructField("surrogate", Ty.StringType())])
_ARROW_ENTITY = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])


def _rewrite(text: str | None, attempts: dict, key: bytes) -> tuple[str | None, list[dict]]:
    if not text:
        return text, []
    out, said, at = [], [], 0
    for start, end, kind, canon in detect(text):
        if start < at:
            continue
        new = render(text[start:end], kind, surrogate(kind, canon, attempts.get((kind, canon), 0), key))
        out += [text[at:start], new]
        said.append({"kind": kind, "start": start, "end": end, "surrogate": new})
        at = end
    return "".join([*out, text[at:]]) if said else text, said


def replace(df: DataFrame, key: bytes = b"surrogates", broadcast_most: int = BROADCAST_MOST) -> DataFrame:
    """``df`` (doc_id, text, ...) with rewritten ``text`` and a column ``entities``.

    ``entities`` lists kind, position in the old text and replacement. A null text stays
    null, a text without entities is unchanged; null ids and repeated rows are rewritten
    like all others; every other column passes through, but for one named ``entities``,
    which is replaced; an empty table gives no rows. Texts are read whole.
    """
    src = df.drop("entities")
    found = spans(src)
    again = materialise(settle(found.select("kind", "canon").distinct(), key), "again")
    count = again.limit(broadcast_most + 1).count()
    table, own = {}, F.lit(None).cast("array<struct<kind:string,canon:string,attempt:int>>")
    if 0 < count <= broadcast_most:
        table = {(r.kind, r.canon): r.attempt for r in again.collect()}
    names = src.columns
    if count > broadcast_most:
        by_doc = (found.join(again, ["kind", "canon"]).groupBy("id")
                  .agg(F.collect_set(F.struct("kind", "canon", "attempt")).alias("__own")))
        src = src.join(by_doc, src["doc_id"].eqNullSafe(by_doc["id"]), "left").drop("id")
        own = F.col("__own")
    src = src.select(*[F.col(f"`{c}`") for c in names], own.alias("__own"))
    shared = df.sparkSession.sparkContext.broadcast(table)
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, said = [], []
            for text, mine in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist()):
                more = {(e["kind"], e["canon"]): e["attempt"] for e in mine} if mine else shared.value
                new, what = _rewrite(text, more, key)
                texts.append(new)
                said.append(what)
            cols = batch.columns[:len(names)]
            cols[where] = pa.array(texts, batch.schema.field(where).type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(said, pa.list_(_ARROW_ENTITY))], [*names, "entities"])

    schema = Ty.StructType([src.schema[c] for c in names] + [Ty.StructField("entities", Ty.ArrayType(ENTITY))])
    return src.mapInArrow(T.lean(run), schema)
