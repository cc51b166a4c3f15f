"""Personal data replaced by keyed surrogates of the same type.

Entities are found by patterns: addresses of mail, IPv4, payment cards, phones, social security and
bank account numbers, secrets (assigned tokens and well-known key forms) and persons after a title.
A surrogate is a keyed hash of kind, normalised entity and attempt, rendered in the entity's form. The key is
the session setting ``plumbline.pii.key``, which keeps surrogates alike over runs; without it, each driver process draws a key
of its own, so that nobody can make the mapping again by trial. Of the form,
separators, case, length and character classes stay; cards keep their issuer digit and their checksum's
truth, bank accounts their country; persons get a name of their title's gender in their script. Bare
mentions of a titled person in the same text, and parts of the name, get the same name or its parts.

Equal entities get one surrogate wherever they stand (coreference). All distinct entities of the table
are checked: where two would share a surrogate, or one is itself an entity of the table, all but the
first try again, until none collide. Where a form has too few surrogates for its entities, those that are
left after ``WIDE_FROM`` attempts get a wider form: any octets (in the end version 6), a further label of the domain, more characters. What differs from the first attempt is few and goes to the tasks as
a table of checked size, or by a join on documents beyond it.

Null text stays null, and empty stays empty; texts without entities are returned unchanged; other columns
pass through; repeated rows are each replaced alike; a table without entities needs no second pass."""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

KEY_SETTING = "plumbline.pii.key"
MAX_EXCEPTIONS = 50_000
#: From this attempt on, surrogates are wider than their entity: any octets, or more characters with each attempt.
WIDE_FROM = 20

#: Titles, and the gender that they tell.
_TITLES = {"Mr": "m", "Herr": "m", "Señor": "m", "Don": "m", "Monsieur": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Doña": "f", "Madame": "f", "Mme": "f", "Sra": "f", "Dr": "n", "Prof": "n", "г-н": "m", "г-жа": "f"}
_PARTICLES = ("van", "von", "der", "den", "de", "del", "di", "da", "la", "le", "bin", "al", "y", "zu")
_UPPER = r"[^\W\d_a-zа-яё]"
#: A part of a name, with hyphens and apostrophes before capitals; and initials.
_PART = rf"(?!(?:{'|'.join(_TITLES)})\b){_UPPER}(?:[^\W\d_]|['’-](?={_UPPER}))+"
_INITIAL = rf"{_UPPER}\.(?= {_UPPER})"
_NAME = rf"(?:{_INITIAL} )*{_PART}(?: (?:(?:{'|'.join(_PARTICLES)}) ){{0,2}}(?:{_INITIAL}|{_PART})){{0,3}}"
_PATTERNS = {
    "secret": r"(?:(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_\-/+]{12,}))|(?P<secret2>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9\-]{20,}|[0-9a-fA-F]{32,64})\b)",
    "email": r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)",
    "iban": r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)",
    "ip": r"(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))",
    "card": r"(?P<card>(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w]|\.\d))",
    "ssn": r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    "phone": r"(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))",
    "person": r"(?P<person>(?<!\w)(?:" + "|".join(_TITLES) + rf")\.? {_NAME})",
}
#: Digits of national numbers by country code, where all have the same.
_NATIONAL = {"1": 10, "7": 10, "33": 9, "34": 9, "44": 10, "45": 8, "47": 8, "48": 9, "51": 9, "52": 10, "57": 10, "61": 9, "65": 8, "86": 11, "91": 10, "351": 9}
LEAST_DIGITS, MOST_DIGITS = 7, 15
#: What a phone's next group may begin in its place: an address, card, social security number, other phone or date; and a year.
_NEXT = re.compile(
    r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)|(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w]|\.\d)"
    r"|\d{3}-\d{2}-\d{4}(?![\w-])|\d{3}[.-]\d{3}[.-]\d{4}(?!\w)|(?:19|20)\d\d[./-]\d\d?[./-]\d\d?(?!\d)|\d\d?[./-]\d\d?[./-](?:19|20)\d\d(?!\d)"
)
_YEAR = re.compile(r"(?:19|20)\d\d(?!\d)")
_ALL = re.compile("|".join(_PATTERNS.values()))
_NUMBERS = re.compile("|".join(p for k, p in _PATTERNS.items() if k != "person"))
_DIGITS = re.compile(r"[0-9]+")
_SIGN = re.compile(r"[0-9@]|(?i:token|secret|passw|key)")


def _phone_end(text: str, start: int, end: int) -> int:
    """Where the phone in text[start:end], which may have taken groups of what follows it, ends: at a blank after a whole national number, before another entity or a year, or within 15 digits."""
    groups = [m.span() for m in _DIGITS.finditer(text, start, end)]
    digits = "".join(text[a:b] for a, b in groups)
    if text[start] != "+" or len(digits) <= LEAST_DIGITS:
        return end
    code = next((c for c in (digits[:1], digits[:2], digits[:3]) if c in _NATIONAL), None)
    before, last = 0, end
    for (a, b), (c, _) in zip(groups, groups[1:]):
        before += b - a
        if text[b:c] != " " or before < LEAST_DIGITS:
            continue
        if before > MOST_DIGITS:
            break
        if code and before - len(code) >= _NATIONAL[code] or _NEXT.match(text, c) or before >= 11 and _YEAR.match(text, c):
            return b
        last = b
    return last if len(digits) > MOST_DIGITS else end


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in a text, left to right, without overlap."""
    titled = any(t in text for t in _TITLES)
    if not titled and not _SIGN.search(text):
        return []
    out, pattern, at = [], _ALL if titled else _NUMBERS, 0
    while m := pattern.search(text, at):
        group = m.lastgroup
        start, end = m.span(group)
        at = m.end()
        if group == "phone":
            at = end = _phone_end(text, start, end)
        out.append((start, end, group.removesuffix("2")))
    return out


def normal(kind: str, found: str) -> str:
    """The entity that a span names: the same for all its ways of writing."""
    if kind in ("card", "ssn", "phone"):
        return re.sub(r"\D", "", found)
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "email":
        return found.lower()
    if kind == "person":
        title, _, name = found.partition(" ")
        return f"{_TITLES[title.rstrip('.')]} {' '.join(name.casefold().split())}"
    return found


def _within(parts: tuple[str, ...], whole: tuple[str, ...]) -> tuple[int, ...] | None:
    """Places of the parts in the whole name, in its order."""
    at, out = 0, []
    for p in parts:
        if p not in whole[at:]:
            return None
        at = whole.index(p, at) + 1
        out.append(at - 1)
    return tuple(out)


def mentions(text: str) -> list[tuple[int, int, str, str, tuple[int, ...] | None]]:
    """Spans (start, end, kind, entity, which parts of a person's name) in a text, left to right: what find() finds, and bare mentions of its persons and of parts of their names.

    A name belongs to the longest name of the text that holds its parts in order and may be of its gender, of several the last that was named before."""
    spans = find(text)
    if all(k != "person" for *_, k in spans):
        return [(a, b, k, normal(k, text[a:b]), None) for a, b, k in spans]
    titled, genders = {}, {}
    for a, b, kind in spans:
        if kind == "person":
            gender, *parts = normal(kind, text[a:b]).split(" ")
            titled[a] = gender, tuple(parts)
            genders.setdefault(tuple(parts), set()).add(gender)
    # one name with a title that tells no gender and one that does is one person
    known = {p: g - {"n"} if len(g) == 2 and "n" in g else g for p, g in genders.items()}
    names: dict[tuple[str, tuple[str, ...]], int] = {}
    for a, (gender, parts) in titled.items():
        names.setdefault((gender if gender in known[parts] else min(known[parts]), parts), a)
    holders: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
    for name in names:
        for p in dict.fromkeys(name[1]):
            holders.setdefault(p, []).append(name)

    def owner(parts: tuple[str, ...], gender: str, at: int) -> tuple[str, tuple[int, ...]] | None:
        best = None
        for g, whole in holders.get(parts[-1], ()):
            if "n" in (g, gender) or g == gender:
                which, first = _within(parts, whole), names[g, whole]
                rank = (len(whole), first <= at, first if first <= at else -first)
                if which is not None and (best is None or rank > best[0]):
                    best = rank, f"{g} {' '.join(whole)}", which
        return best and best[1:]

    words = {w for a, b, k in spans if k == "person" for w in text[a:b].split(" ")[1:] if len(w) > 1 and w[0] != w[0].lower() and not w.endswith(".")}
    some = "|".join(map(re.escape, sorted(words | {w.upper() for w in words}, key=lambda w: (-len(w), w))))
    bare = re.compile(rf"(?<!\w)(?:{some})(?: (?:(?:{'|'.join(_PARTICLES)}) )*(?:{some}))*(?!\w)")
    out, last = [], 0
    for start, end, kind in [*spans, (len(text), len(text), "")]:
        for m in bare.finditer(text, last, start):
            a, found = m.start(), tuple(m[0].casefold().split(" "))
            whose = owner(found, "n", a)
            if whose:
                out.append((a, m.end(), "person", *whose))
                continue
            for w in re.finditer(r"[^ ]+", m[0]):  # parts of several names
                whose = w[0] not in _PARTICLES and owner((w[0].casefold(),), "n", a)
                if whose:
                    out.append((a + w.start(), a + w.end(), "person", *whose))
        if kind == "person":
            gender, parts = titled[start]
            out.append((start, end, kind, *owner(parts, gender if gender in known[parts] else min(known[parts]), start)))
        elif kind:
            out.append((start, end, kind, normal(kind, text[start:end]), None))
        last = end
    return out


class _Stream:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.key, self.seed, self.at, self.held = key, f"{kind}\0{entity}\0{attempt}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 4:
            self.held += hmac.new(self.key, self.seed + b"\0%d" % self.at, hashlib.sha256).digest()
            self.at += 1
        x, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return x * n >> 32


def _like(text: str, r: _Stream) -> str:
    """Each letter and digit replaced within its class and script; other characters stay."""
    out = []
    for c in text:
        if c.isdigit() and c.isascii():
            out.append(str(r.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + r.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + r.below(26)))
        elif "а" <= c <= "я":
            out.append(chr(0x430 + r.below(32)))
        elif "А" <= c <= "Я":
            out.append(chr(0x410 + r.below(32)))
        elif c.isalpha():
            out.append(chr(97 + r.below(26)) if c.islower() else chr(65 + r.below(26)))
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def _name(r: _Stream, gender: str, script: str, more: int = 0) -> str:
    consonants, vowels, ends = ("bcdfglmnprstv", "aeiou", {"m": ("o", "en", "us"), "f": ("a", "ia", "ine"), "n": ("el", "is", "ey")}) if script == "latin" else ("бвгдклмнпрст", "аеиоу", {"m": ("ов", "ин", "ан"), "f": ("ова", "ина", "ая"), "n": ("ко", "ич", "ер")})
    body = "".join(consonants[r.below(len(consonants))] + vowels[r.below(len(vowels))] for _ in range(2 + r.below(2) + more))
    return (body + consonants[r.below(len(consonants))] + ends[gender][r.below(3)]).capitalize()


def _part(r: _Stream, part: str, gender: str, script: str, more: int) -> str:
    """A part of a name; its hyphens, apostrophes and initials stay such."""

    def new(m: re.Match) -> str:
        if len(m[0]) > 1:
            return _name(r, gender, script, more).casefold()
        return chr(97 + r.below(26)) if script == "latin" else chr(0x430 + r.below(32))

    return re.sub(r"[^\W\d_]+", new, part)


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The normalised entity's replacement, in normalised form."""
    r = _Stream(key, kind, entity, attempt)
    more = max(0, attempt - WIDE_FROM + 1)
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity):
            alphabet = "0123456789abcdef" if entity == entity.lower() else "0123456789ABCDEF"
            return "".join(alphabet[r.below(16)] for _ in range(len(entity) + more))
        head = re.match(r"AKIA|gh[pousr]_|sk-|", entity)[0]
        return head + _like(entity[len(head) :] + "a" * 4 * more, r)
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        return _like(local, r) + "@" + ".".join([*(_like(x, r) for x in labels[:-1]), *([_like("a" * 4 * more, r)] if more else []), labels[-1]])
    if kind == "ip":
        if more > 20:  # so many addresses that few others are left: one of version 6
            return "2001:db8:" + ":".join(f"{r.below(1 << 16):x}" for _ in range(6))
        if more:
            return ".".join(str(r.below(256)) for _ in range(4))
        return ".".join(str((1 + r.below(9), 10 + r.below(90), 100 + r.below(155))[len(x) - 1]) for x in entity.split("."))
    if kind == "card":
        body = entity[0] + "".join(str(r.below(10)) for _ in range(len(entity) - 2 + more))
        check = (-_luhn(body + "0")) % 10
        return body + str(check if _luhn(entity) == 0 else (check + 1 + r.below(9)) % 10)
    if kind == "iban":
        body = _like(entity[4:] + "0" * more, r)
        return entity[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in body + entity[:2] + '00')) % 97:02d}" + body
    if kind == "phone":
        return entity[0] + "".join(str(r.below(10)) for _ in range(len(entity) - 1 + more))
    if kind == "person":
        gender, _, name = entity.partition(" ")
        script = "latin" if all(ord(c) < 0x370 or c == "’" for c in name) else "cyrillic"
        parts = name.split()
        return f"{gender} " + " ".join(p if p in _PARTICLES and 0 < i < len(parts) - 1 else _part(r, p, gender if i == 0 else "n", script, more) for i, p in enumerate(parts))
    return _like(entity + "0" * more, r)


def render(kind: str, found: str, core: str, which: tuple[int, ...] | None = None) -> str:
    """A surrogate written as the entity was: with its separators, case and title, and those parts of a name that stood there."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(core)
        return "".join([next(digits) if c.isdigit() else c for c in found] + list(digits))
    if kind == "iban":
        chars = iter(core)
        return "".join([c if c == " " else next(chars) for c in found] + list(chars))
    if kind == "email":
        return core.upper() if found.isupper() else core
    if kind == "person":
        words, new = found.split(" "), core.split(" ")[1:]
        which = range(len(new)) if which is None else which
        title, words = words[: len(words) - len(which)], words[len(words) - len(which) :]
        return " ".join([*title, *(x if w == w.lower() else x.upper() if w.isupper() else x.title() for w, x in zip(words, (new[i] for i in which)))])
    return core


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, entity) of all texts, distinct within a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for batch in batches:
            new = set()
            for text in batch.column(0).to_pylist():
                if text:
                    new.update((k, entity) for _, _, k, entity, _ in mentions(text))
            new -= seen
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*new)], ["kind", "entity"])
            seen = seen | new if len(seen) < 500_000 else new

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, entity string").distinct()


def _with_surrogates(rows: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(key, *x) for x in zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "attempt")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "entity", "attempt")), pa.array(made, pa.string())], ["kind", "entity", "attempt", "surrogate"])

    return rows.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, surrogate string")


@lru_cache(1)
def _own_key() -> bytes:
    return secrets.token_bytes(32)


def key_of(spark: SparkSession) -> bytes:
    """The configured key, or that of this driver process."""
    set_to = spark.conf.get(KEY_SETTING, None)
    return set_to.encode() if set_to else _own_key()


def surrogate_table(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt, surrogate) of every distinct entity: one surrogate each, none shared, none an entity of the table."""
    table = cut(_with_surrogates(entities(docs).withColumn("attempt", F.lit(0)), key), "surrogates")
    while True:  # wider forms have room for all
        # an entity with the fewest attempts keeps a surrogate that several want
        first = table.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("first"))
        taken = table.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        judged = table.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left").withColumn("bad", (F.col("first.entity") != F.col("entity")) | F.col("real").isNotNull())
        judged = cut(judged.select("kind", "entity", "attempt", "surrogate", "bad"), "judged")
        if judged.where("bad").isEmpty():
            return table
        again = _with_surrogates(judged.where("bad").withColumn("attempt", F.col("attempt") + 1), key)
        table = cut(judged.where("not bad").drop("bad").unionByName(again), "surrogates")


def replace(docs: DataFrame, table: DataFrame, key: bytes) -> DataFrame:
    """docs with surrogates in text, and n_entities."""
    spark = docs.sparkSession
    others = cut(table.where("attempt > 0"), "exceptions")
    small = others.count() <= MAX_EXCEPTIONS
    listed = spark.sparkContext.broadcast({(r["kind"], r["entity"]): r["surrogate"] for r in others.collect()} if small else {})
    names = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(*names)
    if not small:  # exceptions of each row, by a join on the entities that it holds
        rows = rows.withColumn("_copy", F.xxhash64("text"))

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = {(c, k, entity) for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for _, _, k, entity, _ in mentions(t)}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int64(), pa.string(), pa.string()))], ["_copy", "kind", "entity"])

        own = rows.select("_copy", "text").mapInArrow(held, "_copy long, kind string, entity string").distinct().join(others, ["kind", "entity"])
        own = own.groupBy("_copy").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x00", "kind", "entity"), "surrogate"))).alias("_own"))
        rows = rows.join(own, "_copy", "left").select(*names, "_own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = listed.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, counts = [], []
            own = batch.column("_own").to_pylist() if "_own" in batch.schema.names else None
            for i, text in enumerate(batch.column(at).to_pylist()):
                spans = mentions(text) if text else []
                counts.append(len(spans))
                if spans:
                    parts, last = [], 0
                    local = dict(own[i] or ()) if own else {}
                    for a, b, kind, entity, which in spans:
                        core = known.get((kind, entity)) or local.get(f"{kind}\x00{entity}") or surrogate(key, kind, entity, 0)
                        parts += [text[last:a], render(kind, text[a:b], core, which)]
                        last = b
                    text = "".join([*parts, text[last:]])
                texts.append(text)
            columns = [pa.array(texts, batch.schema.field(at).type) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*names, "n_entities"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", n_entities long")


def pseudonymise(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with every entity in text replaced by its surrogate, and n_entities. Without a key, that of the session."""
    key = key or key_of(docs.sparkSession)
    return replace(docs, surrogate_table(docs, key), key)
