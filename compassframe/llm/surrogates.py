"""Keyed surrogates for personal data: each entity gets one replacement of its own type and format, everywhere.

E-mail addresses, phone and card numbers, IPv4 addresses, secrets and names after a title are found in whole texts.
A replacement is drawn by a keyed hash of type and entity: digits for digits, letters of the same script for letters,
given names of the gender that any of the person's titles tells. Names without a title are found where a title
names them elsewhere in the text. Draws are checked over all entities of the corpus: two entities never share a
replacement and none is an entity that occurs; those that clash draw again. Mentions that differ in case or
punctuation are one entity and keep their own form.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compassframe.llm.common import BROADCAST_ROWS, Scratch, attach, documents

KEY = "compassframe"
MASCULINE = "Mr|Herr|Señor|Sr|Monsieur|Don|г-н"
FEMININE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Doña|г-жа"
NEUTRAL = "Dr|Prof"
GIVEN = {
    ("m", "latin"): "Adrian Bruno Carl Daniel Emil Felix Gabriel Hugo Ivan Jonas Karim Leon Marc Noah Oscar Paul Ramon Simon Theo Victor".split(),
    ("f", "latin"): "Alice Bianca Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nora Olivia Paula Rosa Sofia Tessa Vera".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Максим Никита Олег Павел Роман Степан Юрий".split(),
    ("f", "cyrillic"): "Алина Белла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Юлия".split(),
}
GIVEN[("n", "latin")] = "Alex Chris Dominique Jamie Kim Robin Sacha Taylor".split()
GIVEN[("n", "cyrillic")] = "Женя Саша Валя".split()
#: Alphabets that stand for each other, letter by letter.
ALPHABETS = {
    "latin": "abcdefghijklmnopqrstuvwxyz", "accented": "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}
DIGITS = "0123456789"
#: Letters whose given names come from GIVEN; other scripts and initials get letters like their own.
NAMED = frozenset(chr(x) for x in (*range(0x61, 0x250), *range(0x400, 0x530)))
_CLASS = {c: a for a in ALPHABETS.values() for c in a} | {c: DIGITS for c in DIGITS}

EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)++")
#: Phones: an area code set apart; + and pairs or any groups; a trunk 0 and pairs or digits alone; ten digits as in NANP.
NUMBER = re.compile(r"(?<![\w.+])(?:(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)|(?P<card>\d(?:[ -]?\d){12,18})(?![\w-])"
                    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}"
                    r"|\+\d{7,15}|(?:\+\d{1,3}[ .-]?(?:\(0\)[ ]?)?\d|0\d)(?:[ .-]\d{2}){4}|\+\d(?:[ .()-]{0,2}\d){6,14}"
                    r"|(?<![/-])(?:1?[2-9]\d{2}[2-9]\d{6}|0[1-9]\d{8,9}))(?![\w-]))")
#: A secret in quotes goes up to the quote, others as far as their characters do.
SECRET = re.compile(r"(?i)(?<!\w)(?:api[_-]?key|token|secret|password|passwd)\b[\"']?\s{0,3}[=:]\s{0,3}"
                    r"(?:[\"'](?P<quoted>[^\s\"']{8,}+)(?=[\"'])|[\"']?(?P<secret>[\w+/.~-]{8,}+={0,2}))")
_MARKS = "".join(chr(x) for x in range(0x300, 0x20000) if unicodedata.category(chr(x))[0] == "M")
#: A word of a name: letters with their marks, O'Neil but not Neil's.
PART = re.compile(rf"[^\W\d_][\w{_MARKS}]*+(?:['’](?!s\b)[^\W\d_][\w{_MARKS}]*+)*+")
#: What stands between the words of a name, with the small words that belong to it.
BETWEEN = re.compile(r"(?:[ -]|\.[ ]?)(?:(?:van|von|vom|der|den|de|del|della|di|da|dos|du|la|le|el|al|bin|ibn|zu|zur|af|av|y)[ -])*+")
HINT = re.compile(r"[\d@]|token|secret|password|passwd|key", re.IGNORECASE)
TITLE = re.compile(rf"(?<!\w)(?:(?P<m>{MASCULINE})|(?P<f>{FEMININE})|(?P<n>{NEUTRAL}))\.? ")

Mention = tuple[int, int, str, str]  # start, end, kind, entity


def lowercase(c: str) -> bool:
    return c.islower() and c.upper() != c


def titled(text: str) -> Iterator[tuple[str, list[re.Match]]]:
    """Gender of each title and the words of the name after it, to the name's end.

    A name ends before a small letter; where letters have no case, at the end of the words.
    """
    at = 0
    while m := TITLE.search(text, at):
        parts, at = [], m.end()
        start = at
        while (p := PART.match(text, start)) and not lowercase(p.group()[0]):
            if text[p.end() : p.end() + 1] == "." and TITLE.match(text, start):  # of a next title
                break
            initial = len(p.group()) == 1 and p.group().isupper()
            if initial and text[p.end() : p.end() + 1] != ".":
                break
            parts.append(p)
            at = p.end()
            between = BETWEEN.match(text, at)
            if not between or (between.group()[0] == "." and not initial):
                break
            start = between.end()
        if parts:
            yield next(g for g in "mfn" if m.group(g)), parts


def names(text: str) -> list[tuple[int, int, str, str, str]]:
    """Names after a title and all repeats of their words: start, end, kind, entity, person (the whole name)."""
    found, first = {}, {}
    for gender, parts in titled(text):
        person = " ".join(p.group().lower() for p in parts)
        for i, p in enumerate(parts):
            kind = f"given_{gender}" if i == 0 and len(parts) > 1 else "family"
            word = p.group().lower()
            found[p.start()] = (p.start(), p.end(), kind, word, person)
            first.setdefault(word, found[p.start()])
    out, last = list(found.values()), {}
    if not out:
        return out
    caseless = [w for w in first if len(w) > 1 and w.upper() == w]  # may stand inside of longer words
    inside = re.compile("|".join(map(re.escape, sorted(caseless, key=len, reverse=True)))) if caseless else None
    for p in PART.finditer(text):  # the last name before with that word, or else the first
        word = p.group().lower()
        if p.start() in found:
            last[word] = found[p.start()]
        elif like := last.get(word) or first.get(word):
            if len(word) > 1 and not lowercase(p.group()[0]):
                out.append((p.start(), p.end(), *like[2:]))
        elif inside:
            out += [(*m.span(), *(last.get(m.group()) or first[m.group()])[2:]) for m in inside.finditer(text, *p.span())]
    return out


def persons(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """Mentions with the person they belong to (empty but for names), in order and without overlaps.

    Of those that start together the longest wins, then the kind named first in the list below.
    """
    if not text:
        return []
    found: list[tuple[int, int, str, str, str]] = []
    if HINT.search(text):
        found += [(*m.span(), "email", m.group().lower(), "") for m in EMAIL.finditer(text)] if "@" in text else []
        for m in SECRET.finditer(text):
            which = "quoted" if m.group("quoted") else "secret"
            if any(c.isalnum() for c in m.group(which)):
                found.append((*m.span(which), "secret", m.group(which), ""))
        for m in NUMBER.finditer(text):
            kind = m.lastgroup
            if kind == "ip" and all(int(x) < 256 for x in m.group().split(".")):
                found.append((*m.span(), "ip", m.group(), ""))
            elif kind in ("card", "phone") and (kind == "card" or 7 <= sum(c.isdigit() for c in m.group()) <= 15):
                found.append((*m.span(), kind, "".join(c for c in m.group() if c.isdigit()), ""))
    if TITLE.search(text):
        found += names(text)
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def detect(text: str | None) -> list[Mention]:
    return [m[:4] for m in persons(text)]


class Stream:
    """Numbers from a keyed hash."""

    def __init__(self, *parts: str):
        self.seed, self.block, self.pool = "\x1f".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.blake2b(self.seed, digest_size=64, salt=self.block.to_bytes(8, "little")).digest()
            self.block += 1
        got, self.pool = int.from_bytes(self.pool[:4], "little"), self.pool[4:]
        return got % n


@lru_cache(maxsize=1 << 16)
def letters_like(c: str) -> str:
    """What may stand for a letter or digit outside ALPHABETS: letters of its script and kind nearby in Unicode."""
    if c.isdecimal():
        return "".join(chr(ord(c) - int(c) + i) for i in range(10))
    if not c.isalpha():
        return DIGITS if c.isalnum() else ""
    script = unicodedata.name(c, "").split(" ")[0]
    return _letters(script, unicodedata.category(c), {"CJK": -1, "HANGUL": -2}.get(script, ord(c) >> 7))


@lru_cache(maxsize=1 << 10)
def _letters(script: str, category: str, block: int) -> str:
    reach = {-1: range(0x4E00, 0x9FA6), -2: range(0xAC00, 0xD7A4)}.get(block, range(block << 7, (block + 1) << 7))
    pool = [c for c in map(chr, reach) if unicodedata.category(c) == category and unicodedata.name(c, "").split(" ")[0] == script]
    return "".join(pool) if len(pool) > 1 else ALPHABETS["latin"]


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def surrogate(kind: str, entity: str, attempt: int, key: str = KEY) -> str:
    """A replacement of the entity, in its normal form. Later attempts on a small set of forms grow longer."""
    s = Stream(key, kind, entity, str(attempt))

    def alike(text: str, letters: dict[str, str] = _CLASS) -> str:
        return "".join(a[s.below(len(a))] if (a := letters.get(c.lower()) or letters_like(c)) else c for c in text)

    longer = max(0, attempt - 6)
    if kind == "ip":
        span = {1: (0, 10), 2: (10, 100), 3: (100, 256)}
        return ".".join(str(lo + s.below(hi - lo)) for lo, hi in (span[len(x)] for x in entity.split(".")))
    if kind == "card":
        new = str(1 + s.below(9)) + alike(entity[1:]) + alike("0" * longer)
        return new[:-1] + next(d for d in DIGITS if luhn(new[:-1] + d) == 0) if luhn(entity) == 0 else new
    if kind == "phone":
        keep = max(0, len(entity) - 10, entity[0] == "0")  # the country code, or a trunk 0
        return entity[:keep] + str(2 + s.below(8)) + alike(entity[keep + 1 :]) + alike("0" * longer)
    if kind == "email":
        name, _, domain = entity.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{alike(name)}{alike('a' * longer)}@{alike(host)}.{top}"
    script = "cyrillic" if any(c in ALPHABETS["cyrillic"] for c in entity) else "latin"
    pool = GIVEN.get((kind[-1], script)) if kind.startswith("given") and entity[0] in NAMED and len(entity) > 1 else None
    if pool:
        vowels = "аеио" if script == "cyrillic" else "aeio"
        rest = "".join(ALPHABETS[script][s.below(20)] + vowels[s.below(4)] for _ in range(attempt))
        return pool[s.below(len(pool))].lower() + rest
    if kind == "secret":
        hexadecimal = _CLASS | dict.fromkeys("abcdef", "abcdef") if re.fullmatch("[0-9a-fA-F]+", entity) else _CLASS
        return "".join(x.upper() if c.isupper() else x for c, x in zip(entity, alike(entity, hexadecimal), strict=True)) + alike("a" * longer, hexadecimal)
    return alike(entity) + alike("a" * longer if script == "latin" else "а" * longer)


def render(mention: str, kind: str, new: str) -> str:
    """The replacement in the mention's own case and punctuation."""
    if kind in ("card", "phone"):
        digits, out = iter(new), []
        for c in mention:
            out.append(next(digits, "") if c.isdigit() else c)
        return "".join(out) + "".join(digits)
    if kind == "email":
        same = len(new) == len(mention)
        return "".join(x.upper() if c.isupper() else x for c, x in zip(mention, new, strict=True)) if same else new
    if kind.startswith("given") or kind == "family":
        return new.upper() if mention.isupper() and len(mention) > 1 else new[:1].upper() + new[1:]
    return new


def drawn(entities: DataFrame, attempt: int, key: str) -> DataFrame:
    """kind, entity, surrogate of that attempt."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names = batch.column("kind").to_pylist(), batch.column("entity").to_pylist()
            new = [surrogate(k, e, attempt, key) for k, e in zip(kinds, names, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (kinds, names, new)], ["kind", "entity", "surrogate"])

    return entities.select("kind", "entity").mapInArrow(draw, "kind string, entity string, surrogate string")


def assign(entities: DataFrame, scratch: Scratch, key: str = KEY) -> DataFrame:
    """kind, entity, surrogate for distinct entities; surrogates are distinct in a kind and none is or holds its entity
    or is another.

    In each round the surrogates drawn are compared with all entities and all accepted ones; of those that meet at
    one, the entity first in order has it. What is left draws again, with ever more forms to draw from.
    """
    accepted, left, attempt = None, entities, 0
    while True:
        tried = scratch.put(drawn(left, attempt, key), f"drawn{attempt}")
        taken = entities.select("kind", F.col("entity").alias("surrogate"))
        if accepted is not None:
            taken = taken.union(accepted.select("kind", "surrogate"))
        first = tried.where(~(F.col("surrogate").contains(F.col("entity")) & (F.length("entity") > 1))).groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        won = scratch.put(first.join(taken.distinct(), ["kind", "surrogate"], "left_anti").select("kind", "entity", "surrogate"), f"won{attempt}")
        accepted = won if accepted is None else accepted.unionByName(won)
        left = scratch.put(tried.join(won, ["kind", "entity"], "left_anti").select("kind", "entity"), f"left{attempt}")
        attempt += 1
        if left.isEmpty():
            return accepted


def keyed(mention: tuple[int, int, str, str, str]) -> tuple[str, str, str]:
    """kind, entity, and of given names the person, whose gender other mentions may tell."""
    *_, kind, entity, person = mention
    return kind, entity, person if kind.startswith("given") else ""


def gendered(mentions: DataFrame, scratch: Scratch) -> DataFrame:
    """mentions with kind: that found, but a title without gender takes it from the person's other titles in the corpus.

    A person is a whole name; one with titles of both genders stays without.
    """
    has = lambda g: F.max(F.col("found") == f"given_{g}")
    people = mentions.where("person <> ''").groupBy("person").agg(has("m").alias("m"), has("f").alias("f"), has("n").alias("n"))
    told = people.where("n AND m <> f").select("person", F.when(F.col("m"), "given_m").otherwise("given_f").alias("told"))
    joined = attach(mentions, scratch.put(told, "told"), ["person"])
    return joined.select(*mentions.columns, F.when(F.col("found") == "given_n", F.col("told")).alias("told")).select(
        *mentions.columns, F.coalesce("told", "found").alias("kind"))


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """One row per row of docs: doc_id, n_mentions, kinds (kind:number, comma-joined) and text with surrogates.

    Reads doc_id and text, either may be null; a null text stays null and texts without mentions stay as they are.
    Repeated rows get the same text. The same key gives the same surrogates for the same set of entities.
    """
    scratch, row = Scratch(docs.sparkSession, "surrogates"), ["doc_id", "text_hash"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, names, people = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for kind, entity, person in sorted({keyed(m) for m in persons(text)}):
                    at.append(i)
                    kinds.append(kind)
                    names.append(entity)
                    people.append(person)
            picked = batch.select(row).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, *[pa.array(x, pa.string()) for x in (kinds, names, people)]], [*row, "found", "entity", "person"])

    mentions = scratch.put(rows.mapInArrow(find, f"doc_id {id_type}, text_hash bigint, found string, entity string, person string"), "found")
    mentions = scratch.put(gendered(mentions, scratch), "mentions")
    mapping = assign(scratch.put(mentions.select("kind", "entity").distinct(), "entities"), scratch, key)
    wanted = mentions.join(scratch.put(mapping, "mapping"), ["kind", "entity"]).groupBy(*row).agg(
        F.collect_set(F.struct("found", "entity", "person", "kind", "surrogate")).alias("news"))
    wanted = scratch.put(wanted, "wanted")
    few = mentions.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        joined = attach(rows, wanted, row)
    else:
        same = [rows[c].eqNullSafe(wanted[c]) for c in row]
        joined = rows.join(wanted, same, "left").select(*[rows[c] for c in rows.columns], "news")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, kinds, texts = [], [], []
            for text, news in zip(batch.column("text").to_pylist(), batch.column("news").to_pylist(), strict=True):
                new = {(x["found"], x["entity"], x["person"]): (x["kind"], x["surrogate"]) for x in news or []}
                seen, out, end = {}, [], 0
                for m in persons(text) if new else []:
                    a, b, (kind, other) = m[0], m[1], new[keyed(m)]
                    out += [text[end:a], render(text[a:b], kind, other)]
                    end = b
                    seen[kind] = seen.get(kind, 0) + 1
                texts.append("".join([*out, text[end:]]) if out else text)
                counts.append(sum(seen.values()))
                kinds.append(",".join(f"{k}:{n}" for k, n in sorted(seen.items())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_mentions", "kinds", "text"])

    return joined.select("doc_id", "text", "news").mapInArrow(apply, f"doc_id {id_type}, n_mentions bigint, kinds string, text string")


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir))
