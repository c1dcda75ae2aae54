"""Format-preserving pseudonyms of personal values by keyed Feistel permutation (operator 4).

Values are found by pattern and validated (Luhn sum, IBAN sum, octets, calendar, number ranges).  A value is a sequence of
symbols, each from its own alphabet (digits, lower or upper case letters, hexadecimal digits, octets); separators
stay.  Eight Feistel rounds add to one half a keyed hash of the other half, symbol by symbol, modulo the alphabet's size:
a permutation of all values of that format.  Where a format has a check sum or a range, only the free symbols are
permuted and the sum is made anew, or the permutation is walked on until the value is valid again.
So equal values have equal pseudonyms in all documents, different ones different pseudonyms, and nothing but
the key links them; with the key, values can be read back.  A number that fails the Luhn sum stays a number that fails it.

An IBAN has the length of its country, so words that follow it are not taken for a part of it; for other countries or lengths the
longest start of the match with a right check sum counts.  Where none has one, the search goes on inside the match.

Defined cases: a null text stays null; a text without such a value stays as it is; other columns stay.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerbank.llm.common import table, widened

#: Callers pass their own secret; this one serves the registered query.
KEY = b"replace this key"
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

# Formats. Order matters: the first that matches and is valid counts.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
FORMATS = {
    "email": r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "number": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){11,18}(?![A-Za-z0-9])",
    # Behind numbers, of which it could be the beginning.
    "spaced": r"(?<![A-Za-z0-9+])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: IBAN lengths by country.
IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (
        x.split(":")
        for x in (
            "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA"
            " 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM"
            " 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for country in countries.split(",")
}
FINDER = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in FORMATS.items()))
IBAN, SECRET = re.compile(FORMATS["iban"]), re.compile(FORMATS["secret"])
#: What follows a value and can belong to the match of an IBAN pattern, at most.
CONTEXT = 64
#: Any value holds an @, or two digits, or is a long run of hexadecimal digits.
HINT = re.compile(r"@|[0-9]{2}|[0-9][.][0-9]|[0-9a-fA-F]{32}")


class Feistel:
    """Keyed permutation of sequences of symbols; symbol i is a number under ``sizes[i]``."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _pad(self, kind: str, turn: int, sizes: tuple[int, ...], half: list[int], n: int) -> Iterator[int]:
        label = repr((kind, turn, sizes, half)).encode()
        count = 0
        while n > 0:
            block = hashlib.blake2b(label + count.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            yield from (int.from_bytes(block[k : k + 4], "big") for k in range(0, 4 * min(n, 16), 4))
            n, count = n - 16, count + 1

    def permute(self, kind: str, symbols: list[int], sizes: list[int], back: bool = False) -> list[int]:
        """The pseudonym of ``symbols`` (of the pseudonym, with ``back``)."""
        symbols, shape, middle = list(symbols), tuple(sizes), len(symbols) // 2
        for turn in reversed(range(self.rounds)) if back else range(self.rounds):
            low, high = (0, middle) if turn % 2 else (middle, len(symbols))
            other = symbols[middle:] if turn % 2 else symbols[:middle]
            for k, pad in enumerate(self._pad(kind, turn, shape, other, high - low), low):
                symbols[k] = (symbols[k] + (-pad if back else pad)) % sizes[k]
        return symbols

    def walk(self, kind: str, symbols: list[int], sizes: list[int], valid: Callable[[list[int]], bool], back: bool = False) -> list[int]:
        """As :meth:`permute`, among the valid sequences only (``symbols`` must be one)."""
        symbols = self.permute(kind, symbols, sizes, back)
        while not valid(symbols):
            symbols = self.permute(kind, symbols, sizes, back)
        return symbols


def luhn_digit(digits: list[int]) -> int:
    """The check digit that belongs after ``digits``."""
    return -sum(d if k % 2 else (2 * d) % 9 or d for k, d in enumerate(reversed(digits))) % 10 if digits else 0


def iban_remainder(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def put_back(template: str, replaced: str) -> str:
    """``template`` with its letters and digits replaced in order."""
    symbols = iter(replaced)
    return "".join(next(symbols) if c.isalnum() else c for c in template)


def alphabets(text: str) -> tuple[list[int], list[int], list[str]]:
    """Symbols, sizes and first characters of the digits and letters of ``text``."""
    first = ["0" if c.isdigit() else "a" if c.islower() else "A" for c in text]
    return [ord(c) - ord(a) for c, a in zip(text, first)], [10 if a == "0" else 26 for a in first], first


def letters_and_digits(feistel: Feistel, kind: str, text: str, back: bool) -> str:
    symbols, sizes, first = alphabets(text)
    return "".join(chr(ord(a) + x) for a, x in zip(first, feistel.permute(kind, symbols, sizes, back)))


def pseudonym(feistel: Feistel, kind: str, value: str, back: bool = False) -> str | None:
    """What stands for ``value``; None if it is no valid value of its kind."""
    compact = "".join(c for c in value if c.isalnum())
    if kind == "email":
        name, end = value[: value.rindex(".")], value[value.rindex(".") :]
        return put_back(name, letters_and_digits(feistel, kind, "".join(c for c in name if c.isalnum()), back)) + end
    if kind == "iban":
        if iban_remainder(compact) != 1 or not 15 <= len(compact) <= 34:
            return None
        body = letters_and_digits(feistel, kind + compact[:2], compact[4:], back)
        check = 98 - iban_remainder(compact[:2] + "00" + body)
        return put_back(value, f"{compact[:2]}{check:02d}{body}")
    if kind == "secret":
        found = feistel.permute(kind, [int(c, 16) for c in value], [16] * len(value), back)
        digits = "".join(f"{x:x}" for x in found)
        return digits if value == value.lower() else digits.upper()
    if kind == "ip":
        return ".".join(map(str, feistel.permute(kind, [int(x) for x in value.split(".")], [256] * 4, back)))
    if kind == "date":
        parts = [int(x) for x in re.split(r"[./-]", value)]
        day_first = value[4] != "-"
        year, month, day = (parts[2], parts[1], parts[0]) if day_first else parts
        swapped = day_first and month > 12  # month first
        if swapped:
            month, day = day, month
        try:
            ordinal = datetime.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= ordinal <= LAST_DAY:
            return None
        # A month-first date stays one that can only be read so.
        allowed = lambda x: FIRST_DAY <= (n := x[0] * 512 + x[1] + FIRST_DAY) <= LAST_DAY and (
            not swapped or datetime.date.fromordinal(n).day > 12
        )
        shift = ordinal - FIRST_DAY
        found = feistel.walk(kind + "md"[day_first] + str(swapped), [shift // 512, shift % 512], [(LAST_DAY - FIRST_DAY) // 512 + 1, 512], allowed, back)
        date = datetime.date.fromordinal(found[0] * 512 + found[1] + FIRST_DAY)
        if not day_first:
            return date.isoformat()
        one, two = (date.month, date.day) if swapped else (date.day, date.month)
        return f"{one:02d}{value[2]}{two:02d}{value[5]}{date.year:04d}"
    digits = [int(c) for c in compact if c.isdigit()]
    if kind == "ssn":
        valid = lambda x: (a := x[0] * 100 + x[1] * 10 + x[2]) not in (0, 666) and a < 900 and any(x[3:5]) and any(x[5:])
        return put_back(value, "".join(map(str, feistel.walk(kind, digits, [10] * 9, valid, back)))) if valid(digits) else None
    if kind in ("phone", "spaced"):
        kind = "phone"
        country = len(re.match(r"\+?([0-9]{1,3})(?=[ .(-])|", value)[1] or "") if value[0] == "+" else 0
        rest = feistel.permute(kind, digits[country:], [10] * (len(digits) - country), back)
        return put_back(value, "".join(map(str, digits[:country] + rest)))
    if luhn_digit(digits[:-1]) == digits[-1]:
        body = feistel.permute("card", digits[:-1], [10] * (len(digits) - 1), back)
        return put_back(value, "".join(map(str, [*body, luhn_digit(body)])))
    fails = lambda x: luhn_digit(x[:-1]) != x[-1]
    return put_back(value, "".join(map(str, feistel.walk(kind, digits, [10] * len(digits), fails, back))))


def iban_or_secret(text: str, start: int) -> tuple[str, int] | None:
    """Kind and end of the IBAN or secret that begins at ``start``."""
    if found := IBAN.match(text, start):
        ends = [found.end(), *(k for k in range(start, found.end()) if text[k] == " ")]
        values = [("".join(text[start:end].split(" ")), end) for end in ends]
        length = IBAN_LENGTHS.get(text[start : start + 2])
        for compact, end in sorted(values, key=lambda x: (len(x[0]) != length, -len(x[0]))):
            if 15 <= len(compact) <= 34 and iban_remainder(compact) == 1:
                return "iban", end
    found = SECRET.match(text, start)
    return ("secret", found.end()) if found else None


def replace(feistel: Feistel, text: str, back: bool = False) -> tuple[str, int]:
    """``text`` with pseudonyms, and how many values were replaced."""
    if not HINT.search(text):
        return text, 0
    out, n, done, at = [], 0, 0, 0  # done: end of the last value; at: where the search goes on
    while found := FINDER.search(text, at):
        kind, (start, end) = found.lastgroup, found.span()
        if kind in ("iban", "secret"):
            taken = iban_or_secret(text, start)
            if taken is None:
                at = start + 1
                continue
            kind, end = taken
            value = pseudonym(feistel, kind, text[start:end], back)
            # Walk on until it is found again as the same kind, of the same length.
            while iban_or_secret(value + text[end : end + CONTEXT], 0) != (kind, len(value)):
                value = pseudonym(feistel, kind, value, back)
        else:
            value = pseudonym(feistel, kind, found[0], back)
        at = end
        if value is not None:
            out += text[done:start], value
            n, done = n + 1, end
    return "".join(out) + text[done:], n


def pseudonymised(docs: DataFrame, key: bytes = KEY, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``__replaced``, their number in each row."""
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in batches:
            texts, counts = [], []
            for text in batch.column(place):
                text, n = (None, 0) if not text.is_valid else replace(feistel, text.as_py(), back)
                texts.append(text)
                counts.append(n)
            columns = [pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32())], [*names, "__replaced"])

    return docs.mapInArrow(run, widened(docs.schema, __replaced="int"))


def pseudonymised_documents(spark, sf_dir: str) -> DataFrame:
    """Query op4: documents with pseudonyms for personal values."""
    found = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("__replaced").alias("n_replaced"))


def private(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pseudonyms for personal values; lengths are counted anew where a text changed."""
    columns = docs.columns
    docs = pseudonymised(docs)
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.when(F.col("__replaced") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)
