"""Personal data: entities in texts and keyed surrogates of the same type and form.

A surrogate is a keyed permutation of the entity inside its form: digits become digits,
letters letters of the same script and case, vowels vowels, check digits are worked out
anew.  A permutation maps different entities of one form to different surrogates, and one
entity to one surrogate wherever it stands and however it is written.  What permutations
cannot rule out, a surrogate that is also another form's surrogate, or an entity of the
corpus, is found over all distinct entities and drawn again.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.session import cut_lineage

KEY = b"set a secret key of your own"

# Common given names by script and gender, and forms of address by gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sophie Claire Elena Carmen Lucia Emma Hannah Olivia Charlotte Isabel Martina Katharina".split(),
    ("latin", "m"): "Peter Thomas Michael Daniel Martin Lukas Pierre Antoine Carlos Miguel James Robert William Stefan Andreas Philippe".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Дмитрий Алексей Андрей Михаил Николай".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Κατερίνα Σοφία Γεωργία".split(),
    ("greek", "m"): "Γιώργος Γιάννης Δημήτρης Νίκος Κώστας Παναγιώτης".split(),
}
ADDRESS = {
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Госпожа Κυρία".split(),
    "m": "Mr Herr Monsieur Señor Sr Don Господин Κύριος".split(),
    "": "Dr Prof".split(),
}
_GENDER = {n: (s, g, i) for (s, g), names in GIVEN.items() for i, n in enumerate(names)}
_TITLES = {t: g for g, titles in ADDRESS.items() for t in titles}

# Letters that are exchanged for one another.
_CLASSES = (
    "aeiouy",
    "bcdfghjklmnpqrstvwxz",
    "àáâäãåæèéêëìíîïòóôöõøœùúûü",
    "çñßšžčćđłńśźż",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщ",
    "αεηιουω",
    "άέήίόύώ",
    "βγδζθκλμνξπρστφχψ",
    "0123456789",
)
_CLASS = {c: (k, i) for k, cs in enumerate(_CLASSES) for i, c in enumerate(cs)}


# ---------------------------------------------------------------- permutations


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 to size - 1: a balanced Feistel network on the next even
    number of bits, walked until it falls inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8 + 1
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            told = f"{tweak}|{size}|{r}|{right}".encode()
            digest = hmac.digest(key, told, "sha256")
            while len(digest) < width:
                digest += hashlib.sha256(digest).digest()
            left, right = right, left ^ (int.from_bytes(digest[:width], "big") & mask)
        value = left << half | right
        if value < size:
            return value


def reform(text: str, key: bytes, tweak: str, first_digit: bool = False) -> str:
    """Permute a text among all of its form: each character keeps its class and case, and
    characters of no class stay.  With ``first_digit`` a leading digit stays one of 1 to 9."""
    radices, value, spots = [], 0, []
    for c in text:
        low = c.lower()
        if low in _CLASS and len(low) == 1:
            k, i = _CLASS[low]
            radix = len(_CLASSES[k])
            if first_digit and not spots and low.isdigit() and i:
                radix, i = 9, i - 1
            spots.append((k, c != low))
            radices.append(radix)
            value = value * radix + i
    size = 1
    for r in radices:
        size *= r
    if size <= 1:
        return text
    value = permute(value, size, key, f"{tweak}|{''.join(chr(97 + k) for k, _ in spots)}")
    drawn = []
    for radix, (k, upper) in zip(reversed(radices), reversed(spots), strict=True):
        value, i = divmod(value, radix)
        c = _CLASSES[k][i + (radix == 9 and k == len(_CLASSES) - 1)]
        up = c.upper()
        drawn.append(up if upper and len(up) == 1 else c)
    out = iter(reversed(drawn))
    return "".join(next(out) if c.lower() in _CLASS and len(c.lower()) == 1 else c for c in text)


def _luhn(digits: str) -> int:
    """The check digit that makes the digits valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _card(digits: str, key: bytes, tweak: str) -> str:
    """Same length and first digit; valid stays valid, invalid invalid."""
    body, last = digits[1:-1], int(digits[-1])
    fresh = digits[0] + reform(body, key, f"{tweak}|{digits[0]}")
    return fresh + str((_luhn(fresh) + last - _luhn(digits[:-1])) % 10)


_RANGES = (  # (first address, bits) that stay among themselves
    (10 << 24, 24),
    (172 << 24 | 16 << 16, 20),
    (192 << 24 | 168 << 16, 16),
    (127 << 24, 24),
    (169 << 24 | 254 << 16, 16),
    (224 << 24, 28),
    (240 << 24, 28),
    (0, 24),
)


def _address(text: str, key: bytes, tweak: str) -> str:
    value = 0
    for part in text.split("."):
        value = value << 8 | int(part)

    def home(v: int) -> tuple[int, int] | None:
        return next(((a, b) for a, b in _RANGES if a <= v < a + (1 << b)), None)

    inside = home(value)
    if inside:
        value = inside[0] + permute(value - inside[0], 1 << inside[1], key, tweak)
    else:
        value = permute(value, 1 << 32, key, tweak)
        while home(value):
            value = permute(value, 1 << 32, key, tweak)
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _hex(text: str, key: bytes, tweak: str) -> str:
    fresh = permute(int(text, 16), 1 << 4 * len(text), key, f"{tweak}|{len(text)}")
    out = f"{fresh:0{len(text)}x}"
    return out if text == text.lower() else out.upper()


def _iban(text: str, key: bytes, tweak: str) -> str:
    body = reform(text[4:], key, f"{tweak}|{text[:2]}")
    number = int("".join(str(int(c, 36)) for c in body + text[:2] + "00"))
    return f"{text[:2]}{98 - number % 97:02d}{body}"


def _name(text: str, key: bytes, tweak: str) -> str:
    """Given names by one of the same script and gender, other names by their form; a final
    vowel, which often tells the gender, stays."""
    out = []
    for word in text.split(" "):
        if word in _GENDER:
            script, gender, i = _GENDER[word]
            names = GIVEN[script, gender]
            out.append(names[permute(i, len(names), key, f"{tweak}|{script}{gender}")])
        elif len(word) > 2 and word[-1].lower() in "aeiouyаеёиоуыэюяαεηιουωάέήίόύώ":
            out.append(reform(word[:-1], key, f"{tweak}|{word[-1]}") + word[-1])
        else:
            out.append(reform(word, key, tweak))
    return " ".join(out)


@dataclass(frozen=True)
class Entity:
    kind: str
    canonical: str
    start: int
    end: int


def surrogate(kind: str, canonical: str, attempt: int, key: bytes = KEY) -> str:
    """The replacement of an entity in its canonical writing; each attempt draws another."""
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, host = canonical.rpartition("@")
        *labels, top = host.split(".")
        return f"{reform(local, key, tweak)}@{'.'.join(reform(x, key, tweak + '|' + top) for x in labels)}.{top}"
    if kind == "ip":
        return _address(canonical, key, tweak)
    if kind == "card":
        return _card(canonical, key, tweak)
    if kind == "phone":
        code, _, rest = canonical.rpartition(" ")
        return f"{code} {reform(rest, key, f'{tweak}|{code}', first_digit=True)}".strip()
    if kind == "iban":
        return _iban(canonical, key, tweak)
    if kind == "name":
        return _name(canonical, key, tweak)
    if kind == "access_key":
        return canonical[:4] + reform(canonical[4:], key, tweak)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canonical):
        return _hex(canonical, key, tweak)
    return reform(canonical, key, tweak)


# ---------------------------------------------------------------- finding

_EMAIL = re.compile(r"[^\W_](?:[\w.%+-]*[^\W_])?@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMBER = re.compile(
    rf"(?<![\w.+-])(?:(?P<ip>(?:{_OCTET}\.){{3}}{_OCTET})(?!\.?\d)"
    r"|(?P<card>\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\d-])"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
    r"|(?P<phone>\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d-]))"
    r"(?!\w)"
)
_SECRET = re.compile(
    r"(?i)\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([^\s\"',;]{6,})"
)
_ACCESS = re.compile(r"(?<![\w])(?:AKIA|ASIA)[0-9A-Z]{16}(?![\w])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
# Every number sought has two digits in a row, or is an address of single digits.
_NUMERIC = re.compile(r"\d\d|\d\.\d\.\d")
_CAPITAL = r"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΩЀ-Я][^\W\d_]+"
_WORD = re.compile(rf"(?<!\w)(?:{_CAPITAL})")
_AFTER = re.compile(rf"\.? ({_CAPITAL}(?: {_CAPITAL})?)")
_FAMILY = re.compile(rf" {_CAPITAL}")


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _phone(text: str) -> str | None:
    """Country code (or nothing), a blank, the other digits; None if too few or many."""
    digits = _digits(text)
    if not 7 <= len(digits) <= 15 or not digits.isascii():
        return None
    if not text.startswith("+"):
        return " " + digits if len(digits) == 10 else None
    lead = re.match(r"\+(\d{1,3})(?!\d)", text)
    code = lead.group(1) if lead else digits[:1] if digits[0] in "17" else digits[:2]
    rest = digits[len(code) :]
    return f"+{code} {rest}" if len(rest) >= 6 else None


def _numbers(text: str) -> list[Entity]:
    """Account, card, phone and other numbers."""
    found = []
    for m in _IBAN.finditer(text):
        packed = m.group().replace(" ", "")
        number = "".join(str(int(c, 36)) for c in packed[4:] + packed[:4])
        if 15 <= len(packed) <= 34 and int(number) % 97 == 1:
            found.append(Entity("iban", packed, *m.span()))
    for m in _NUMBER.finditer(text):
        kind, value = m.lastgroup or "", m.group()
        canonical = value if kind == "ip" else _phone(value) if kind == "phone" else _digits(value)
        if canonical and value.isascii():
            found.append(Entity(kind, canonical, *m.span()))
    return found


def find(text: str) -> list[Entity]:
    """Entities of a whole text, in order, none overlapping another; the first kinds win."""
    found: list[Entity] = []
    if "@" in text:
        found += [Entity("email", m.group().lower(), *m.span()) for m in _EMAIL.finditer(text)]
    if "=" in text or ":" in text:
        found += [Entity("secret", m.group(1), *m.span(1)) for m in _SECRET.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        found += [Entity("access_key", m.group(), *m.span()) for m in _ACCESS.finditer(text)]
    if _NUMERIC.search(text):
        found += _numbers(text)
    for m in _WORD.finditer(text):
        word = m.group()
        if word in _TITLES and (after := _AFTER.match(text, m.end())):
            found.append(Entity("name", after.group(1), *after.span(1)))
        elif word in _GENDER and (family := _FAMILY.match(text, m.end())):
            found.append(Entity("name", word + family.group(), m.start(), family.end()))
    out: list[Entity] = []
    taken: list[tuple[int, int]] = []
    if len(found) < 2:
        return found
    ranked = sorted(range(len(found)), key=lambda i: (found[i].start, i))
    for i in ranked:
        e = found[i]
        if not taken or e.start >= taken[-1][1]:
            taken.append((e.start, e.end))
            out.append(e)
    return out


def written_like(original: str, kind: str, fresh: str) -> str:
    """The surrogate in the writing of the original: separators, and an email's case."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = iter(c for c in fresh if c.isalnum())
        return "".join(next(signs) if c.isalnum() else c for c in original)
    if kind == "email" and original.isupper():
        return fresh.upper()
    return fresh


def replace(text: str, attempts: dict[tuple[str, str], int], key: bytes = KEY) -> tuple[str, int]:
    """The text with all entities replaced, and their number."""
    out, at = [], 0
    entities = find(text)
    for e in entities:
        fresh = surrogate(e.kind, e.canonical, attempts.get((e.kind, e.canonical), 0), key)
        out += [text[at : e.start], written_like(text[e.start : e.end], e.kind, fresh)]
        at = e.end
    return "".join([*out, text[at:]]), len(entities)


# ---------------------------------------------------------------- over tables


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``kind`` and ``canonical`` of all distinct entities."""

    @F.pandas_udf("array<struct<kind: string, canonical: string>>")
    def listed(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"kind": k, "canonical": c} for k, c in sorted({(e.kind, e.canonical) for e in find(t)})]
                if isinstance(t, str)
                else []
                for t in texts
            ]
        )

    found = docs.select(F.explode(listed(F.col(f"`{text}`"))).alias("e"))
    return found.select("e.kind", "e.canonical").distinct()


def _drawn(key: bytes):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["kind"], b["canonical"], b["attempt"], strict=True)
            yield b.assign(surrogate=[surrogate(k, c, int(a), key) for k, c, a in rows])

    return run


def attempts(known: DataFrame, key: bytes = KEY) -> DataFrame:
    """Which attempt each entity takes so that no two surrogates of a kind are equal and none
    is an entity of its kind; only entities that need another than the first, 0.

    Of equal surrogates the least entity of the least attempt keeps its own, the others draw
    again and are checked against all, until none is left.
    """
    schema = "kind string, canonical string, attempt int, surrogate string"
    now = known.withColumn("attempt", F.lit(0)).mapInPandas(_drawn(key), schema)
    now = cut_lineage(now, "surrogates")
    originals = known.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
    moved = False
    while True:
        first = now.groupBy("kind", "surrogate").agg(
            F.min(F.struct("attempt", "canonical")).alias("keeper"), F.count(F.lit(1)).alias("n")
        )
        clash = first.join(originals, ["kind", "surrogate"], "left")
        clash = clash.where((F.col("n") > 1) | F.col("real"))
        clash = cut_lineage(clash.select("kind", "surrogate", "keeper.canonical", "real"), "clashes")
        if not clash.take(1):
            break
        moved = True
        again = now.join(clash.withColumnRenamed("canonical", "keeper"), ["kind", "surrogate"], "left")
        loses = F.col("keeper").isNotNull() & (F.col("real").isNotNull() | (F.col("keeper") != F.col("canonical")))
        again = again.select("kind", "canonical", F.col("attempt") + F.coalesce(loses, F.lit(False)).cast("int"))
        again = again.toDF("kind", "canonical", "attempt")
        now = cut_lineage(again.mapInPandas(_drawn(key), schema), "surrogates")
    return now.where("attempt > 0").select("kind", "canonical", "attempt") if moved else now.limit(0).select(
        "kind", "canonical", "attempt"
    )


def pseudonymise(
    docs: DataFrame, key: bytes = KEY, text: str = "text", broadcast_rows: int = 10_000
) -> DataFrame:
    """Every row with its text's entities replaced; column ``n_entities`` is added.

    A null text stays null with no entity, an empty one empty.  Repeated rows get the same
    text, an empty table gives an empty one; other columns stay, but for an input column
    ``n_entities``, which is replaced.  Surrogates come from the key in each task.  The few
    entities that had to draw again travel as a broadcast of ``broadcast_rows`` at most;
    beyond that they are joined to the texts that hold them.
    """
    names = docs.columns
    source = F.col(f"`{text}`")
    known = cut_lineage(entities(docs, text), "entities")
    changed = cut_lineage(attempts(known, key), "attempts")
    if changed.count() <= broadcast_rows:
        table = {(r.kind, r.canonical): r.attempt for r in changed.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(table)

        @F.pandas_udf("text string, n int")
        def fresh(texts: pd.Series) -> pd.DataFrame:
            rows = [replace(t, shared.value, key) if isinstance(t, str) else (None, 0) for t in texts]
            return pd.DataFrame(rows, columns=["text", "n"])

        done = docs.withColumn("__fresh", fresh(source))
    else:
        done = _joined(docs, changed, key, text)
    columns = [
        F.col("__fresh.text").alias(c) if c == text else F.col(f"`{c}`")
        for c in names
        if c.lower() != "n_entities"
    ]
    return done.select(*columns, F.col("__fresh.n").alias("n_entities"))


def _joined(docs: DataFrame, changed: DataFrame, key: bytes, text: str) -> DataFrame:
    """The attempts of each text's own entities, joined by the hash of the text."""

    @F.pandas_udf("array<struct<kind: string, canonical: string>>")
    def listed(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"kind": k, "canonical": c} for k, c in sorted({(e.kind, e.canonical) for e in find(t)})]
                if isinstance(t, str)
                else []
                for t in texts
            ]
        )

    source = F.col(f"`{text}`")
    held = docs.select(F.xxhash64(source).alias("__hash"), F.explode(listed(source)).alias("e"))
    held = held.select("__hash", "e.kind", "e.canonical").distinct().join(changed, ["kind", "canonical"])
    own = held.groupBy("__hash").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("__own"))

    @F.pandas_udf("text string, n int")
    def fresh(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        rows = []
        for t, some in zip(texts, own, strict=True):
            mine = {} if some is None else {(x["kind"], x["canonical"]): x["attempt"] for x in some}
            rows.append(replace(t, mine, key) if isinstance(t, str) else (None, 0))
        return pd.DataFrame(rows, columns=["text", "n"])

    keyed = docs.withColumn("__hash", F.xxhash64(source)).join(own, "__hash", "left")
    return keyed.withColumn("__fresh", fresh(source, F.col("__own")))
