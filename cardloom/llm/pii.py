"""PII replaced by surrogates (operator 9).

Entities are found by patterns and replaced by surrogates of their own type and format. A surrogate is a keyed permutation
of the entity's own domain (all strings of the same shape), so equal entities get equal surrogates wherever they stand,
different ones different surrogates, and no table of entities is shared between tasks. Where only part of a domain is
allowed (card numbers with a valid check digit, public addresses, names outside the name lists), the permutation is walked
on until it lands there again, which keeps it one-to-one: that is the collision check.

Equal means equal beyond format: case, separators, and a phone's notation with or without its country don't matter. A
name's words are replaced one by one by one rule, whatever their place, so a person named in full and by one word stays one.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cardloom.llm.common import in_slices

#: Given names by script and gender, as their surrogates come from the same list.
GIVEN = {
    ("latin", "f"): "Anna Maria Emma Laura Sofia Julia Clara Elena Marie Sarah Lucia Paula Eva Nina Carla Alice Irene Ines Lena Nora".split(),
    ("latin", "m"): "Paul Peter David Thomas Martin Daniel Simon Lukas Marco Adam Oscar Hugo Felix Jonas Bruno Victor Leon Samuel Robert Albert".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Нина Вера Юлия".split(),
    ("cyrillic", "m"): "Иван Павел Олег Игорь Антон Денис Роман Максим".split(),
    ("greek", "f"): "Μαρία Ελένη Σοφία Άννα Ειρήνη Χριστίνα".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Πέτρος Παύλος Αντώνης".split(),
}
#: Titles that introduce a name.
TITLES = "Mrs. Mrs Ms. Ms Miss Frau Mme Madame Mademoiselle Señora Sra. Señorita Г-жа Госпожа Κυρία Mr. Mr Herr Monsieur M. Señor Sr. Г-н Господин Κύριος Dr. Dr Prof. Professor".split()
_TITLES = set(TITLES)
#: Words that no name goes on with; a lone M. is taken for an initial.
_ANEW = (_TITLES | {t.rstrip(".") for t in TITLES}) - {"M", "M."}
#: Calling codes of two digits; 1 and 7 have one digit, all others three.
CALLING = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_NAME, _INITIAL = r"[^\W\d_]+(?:-[^\W\d_]+)*", r"[^\W\d_]\.(?=\x20)"


def _any(words: Iterable[str]) -> str:
    """One of the words, the longest first; a place where none begins is told by one character."""
    first: dict[str, list[str]] = {}
    for word in sorted(words, key=len, reverse=True):
        first.setdefault(word[0], []).append(re.escape(word[1:]))
    return f"(?=[{''.join(first)}])(?:{'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in first.items())})"


_EMAIL = r"[\w.+%-]++@(?:[\w-]+\.)+[A-Za-z]{2,24}"
PATTERNS = {
    "email": rf"(?<![\w.+%-]){_EMAIL}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?\d)",
    "card": r"(?<![\d+])[0-9](?:[\x20-]?[0-9]){12,18}(?!\d)",
    "ssn": r"(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d-])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?)?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?!\d)|\+[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,5}(?!\d)|(?<![\d-])(?<!\d\.)[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?!-|\.?\d)",
    "name": rf"(?<!\w){_any(TITLES)}(?:\x20{_any(TITLES)})*\x20{_NAME}(?:\x20(?:{_INITIAL}|{_NAME})){{0,3}}|(?<!\w){_any(n for ns in GIVEN.values() for n in ns)}\x20{_NAME}(?!\w)",
}
KINDS = tuple(PATTERNS)
_ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: A text without any of these has no entity, and isn't searched further.
_HINT = re.compile(rf"@|[0-9](?:[^A-Za-z]?[0-9]){{3}}|(?<!\w){_any([*TITLES, *(n for ns in GIVEN.values() for n in ns)])}\x20")
_ADDRESS_HERE = re.compile(_EMAIL)

#: Letters and digits that replace each other, in lower case; and ranges of letters without case.
_ALPHABETS = [
    "0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâäèéêëìíîïòóôöùúûü", "āăąēĕėęěīĭįōŏőūŭůűų", "çñ", "ćĉċčďđĝğġģĥħĵķĺļľłńņňŋŕŗřśŝşšţťŧŵźżž",
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ёъь", "іїє", "ґўјљњћђџ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
]
_RANGES = [(0x05D0, 0x05EA), (0x0621, 0x063A), (0x0641, 0x064A), (0x0904, 0x0939), (0x0E01, 0x0E2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
_ALPHABETS += ["".join(map(chr, range(low, high + 1))) for low, high in _RANGES]
_PLACE = {c: (a, i) for a, alphabet in enumerate(_ALPHABETS) for i, c in enumerate(alphabet)}
#: Letters of a name without case and without spaces; of more it can't be told where it ends.
_DENSE = re.compile("[\u3041-\u30fa\u4e00-\u9fff\uac00-\ud7a3]{1,4}")


def _caseless(word: str) -> bool:
    """A name's word in a script without capitals."""
    return not word[0].isupper() and not word[0].islower() and (bool(_DENSE.fullmatch(word)) or not _DENSE.match(word))


class Surrogates:
    """The keyed permutations."""

    def __init__(self, key: bytes):
        self.key = key
        self.lists = {kind: {n.lower(): i for i, n in enumerate(names)} for kind, names in GIVEN.items()}
        self.of = lru_cache(100_000)(self._of)

    def permute(self, x: int, n: int, tweak: str, allowed: Callable[[int], bool] = lambda _: True) -> int:
        """A keyed permutation of the allowed numbers below n: the next one in the order of a Feistel network, walked until
        it is back in the domain. All of them stand in one cycle, so none but an only one is its own surrogate."""
        half = max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
        mask, every = (1 << half) - 1, (1 << 2 * half) - 1

        def told(i: int, right: int) -> int:
            out = hashlib.blake2b(f"{tweak}|{n}|{i}|{right}".encode(), key=self.key, digest_size=max(8, half // 8 + 1)).digest()
            return int.from_bytes(out, "big") & mask

        left, right = x >> half, x & mask
        for i in range(8):
            left, right = right, left ^ told(i, right)
        at = left << half | right
        while True:
            at = at + 1 & every
            left, right = at >> half, at & mask
            for i in reversed(range(8)):
                left, right = right ^ told(i, left), left
            x = left << half | right
            if x < n and allowed(x):
                return x

    def shape(self, text: str, tweak: str, last: bool = False, allowed: Callable[[str], bool] = lambda _: True) -> str:
        """Letters and digits replaced within their own alphabets (case, script, vowels and digits kept), other
        characters as they are, and so, with ``last``, the last letter. ``allowed`` judges texts in lower case; it holds
        for the given one."""
        low = [c.lower() for c in text]
        at = [i for i, c in enumerate(low) if c in _PLACE]
        at = at[: -1 if last and len(at) > 2 else None]
        n, x = 1, 0
        for i in at:
            alphabet, place = _PLACE[low[i]]
            n, x = n * len(_ALPHABETS[alphabet]), x * len(_ALPHABETS[alphabet]) + place
        if n == 1:
            return text
        fixed = list(low)
        for i in at:
            fixed[i] = f"<{_PLACE[low[i]][0]}>"

        def filled(x: int) -> list[str]:
            out = list(low)
            for i in reversed(at):
                alphabet = _ALPHABETS[_PLACE[low[i]][0]]
                x, place = divmod(x, len(alphabet))
                out[i] = alphabet[place]
            return out

        new = filled(self.permute(x, n, f"{tweak}|{''.join(fixed)}", lambda y: allowed("".join(filled(y)))))
        for i, c in enumerate(text):
            if c != low[i] or i not in at:
                new[i] = new[i].upper() if i in at else c
        return "".join(new)

    def _digits(self, text: str, tweak: str, keep: int, allowed: Callable[[str], bool] = lambda _: True, told: str | None = None) -> str:
        """The digits from the keep-th on permuted, separators as they are; ``allowed`` judges all digits. ``told``: the
        head that the permutation goes by, if it isn't that of the kept digits."""
        digits = [c for c in text if c in "0123456789"]
        head, rest = "".join(digits[:keep]), "".join(digits[keep:])
        size = len(rest)
        new = head + str(self.permute(int(rest), 10**size, f"{tweak}|{head if told is None else told}", lambda x: allowed(head + str(x).zfill(size)))).zfill(size)
        fresh = iter(new)
        return "".join(next(fresh) if c in "0123456789" else c for c in text)

    def _address(self, text: str) -> str:
        x = int.from_bytes(bytes(map(int, text.split("."))), "big")
        for head, bits in ((10, 24), (127, 24), (0xC0A8, 16), (0xAC1, 20)):
            if x >> bits == head:
                x = head << bits | self.permute(x & ((1 << bits) - 1), 1 << bits, f"ip|{head}")
                break
        else:
            private = lambda y: any(y >> bits == head for head, bits in ((10, 24), (127, 24), (0xC0A8, 16), (0xAC1, 20)))
            x = self.permute(x, 1 << 32, "ip", lambda y: not private(y))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _word(self, word: str) -> str:
        """A listed given name becomes another one of its list, so script and gender stay. Any other word becomes one of
        its shape that is in no list; it keeps its last letter, which often tells the gender."""
        low = word.lower()
        for kind, places in self.lists.items():
            if low in places:
                new = GIVEN[kind][self.permute(places[low], len(places), "given|" + "|".join(kind))]
                return new.upper() if word.isupper() else new
        return self.shape(word, "word", last=True, allowed=lambda x: not any(x in places for places in self.lists.values()))

    def _name(self, text: str) -> str:
        words = text.split(" ")
        titles = leading_titles(words)
        return " ".join([*words[:titles], *("-".join(map(self._word, w.split("-"))) for w in words[titles:])])

    def _phone(self, text: str) -> str:
        """Ten digits without a country are taken for those of calling code 1."""
        digits = re.sub(r"[^0-9]", "", text)
        if text[0] != "+":
            return self._digits(text, "phone", 0, told="1" if len(digits) == 10 else "")
        return self._digits(text, "phone", 1 if digits[0] in "17" else 2 if digits[:2] in CALLING else 3)

    def _iban(self, text: str) -> str:
        """Country and validity stay: check digits are off the right ones by what they were."""
        plain = text.replace(" ", "")
        country, given, body = plain[:2], int(plain[2:4]), plain[4:]
        new = self.shape(body, f"iban|{country}")
        fresh = iter(f"{country}{(iban_check(country, new) + given - iban_check(country, body)) % 100:02}{new}")
        return "".join(c if c == " " else next(fresh) for c in text)

    def _of(self, kind: str, text: str) -> str:
        if kind == "email":
            local, _, domain = text.rpartition("@")
            host, _, top = domain.rpartition(".")
            return f"{self.shape(local, 'local')}@{'.'.join(self.shape(label, 'label') for label in host.split('.'))}.{top}"
        if kind == "ip":
            return self._address(text)
        if kind == "card":
            valid = luhn(text)
            return self._digits(text, f"card|{valid}", 1, lambda digits: luhn(digits) == valid)
        if kind == "phone":
            return self._phone(text)
        if kind == "iban":
            return self._iban(text)
        if kind == "ssn":
            return self._digits(text, "ssn", 0)
        return self._name(text)


def iban_check(country: str, body: str) -> int:
    """The check digits that make the number 1 modulo 97."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def luhn(text: str) -> bool:
    digits = [int(c) for c in reversed(text) if c in "0123456789"]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def leading_titles(words: list[str]) -> int:
    """How many words introduce a name; the last word never does."""
    n = 0
    while n < len(words) - 1 and words[n] in _TITLES:
        n += 1
    return n


def name_end(name: str) -> int:
    """How far a match of the pattern of names is one, 0 if it isn't any. A name's words begin with capitals; in scripts
    without them the one word after a title is taken."""
    words = name.split(" ")
    first = proper = max(1, leading_titles(words))
    while proper < len(words) and words[proper][0].isupper() and (proper == first or words[proper] not in _ANEW):
        proper += 1
    if proper == first and words[0] in _TITLES and _caseless(words[first]):
        proper += 1
    while proper > first and words[proper - 1].endswith("."):  # an initial that no further name follows
        proper -= 1
    return len(" ".join(words[:proper])) if proper > first else 0


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost first, not overlapping. The search goes on where an entity ends, also where the end came
    from judging its words, and after the first word of what turned out to be none."""
    if not text or not _HINT.search(text):
        return []
    out, at = [], 0
    while True:
        # an address may begin right where an entity ended, in the middle of what would else be one word of it
        m = (out and out[-1][1] == at and _ADDRESS_HERE.match(text, at)) or _ENTITY.search(text, at)
        if not m:
            return out
        start, end, kind = m.start(), m.end(), m.lastgroup or "email"
        if kind == "name":
            if not (upto := name_end(m[0])):
                at = start + m[0].index(" ")
                continue
            end = start + upto
        out.append((start, end, kind))
        at = end


def replace(text: str | None, surrogates: Surrogates) -> tuple[str | None, list[tuple[int, int, str]]]:
    found = entities(text)
    if not found:
        return text, found
    parts, at = [], 0
    for start, end, kind in found:
        parts += [text[at:start], surrogates.of(kind, text[start:end])]
        at = end
    return "".join([*parts, text[at:]]), found


def session_key(spark: SparkSession) -> bytes:
    """The secret of ``spark.cardloom.pii.key``; without one a new random key, so that nobody can turn surrogates back."""
    named = spark.conf.get("spark.cardloom.pii.key", None)
    return hashlib.blake2b(named.encode()).digest() if named else os.urandom(32)


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", spans: bool = False) -> DataFrame:
    """The documents, all columns and rows, with entities in ``text_col`` replaced; with n_<kind> columns for each kind.

    ``spans`` adds where entities stood in the input: an array of (start, end, kind), code points. Null and empty texts
    stay as they are; texts of any length are searched whole. ``key`` is a secret of up to 64 bytes: one key gives the same
    surrogates always. Each row is replaced on its own, so repeated rows and null ids stay alike. Input columns that have the
    name of an added one give way to it.
    """
    counts = [f"n_{k}" for k in KINDS]
    docs = docs.drop(*counts, *["entities"] * spans)
    schema, at = docs.schema, docs.columns.index(text_col)
    added = [f"{name} int" for name in counts] + ["entities array<struct<start:int,end:int,kind:string>>"] * spans
    schema = T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(added)).fields])
    kind_of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for batch in in_slices(batches):
            done = [replace(t, surrogates) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            columns += [pa.array([sum(f[2] == k for f in found) for _, found in done], pa.int32()) for k in KINDS]
            if spans:
                columns.append(pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in found] for _, found in done], kind_of))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
