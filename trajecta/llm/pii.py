"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Every value found is checked (octets of an address, days of a month, check digits), then moved by a permutation of all
values of its own format: the same number of digits, a valid date, a valid check digit. Equal values get equal
pseudonyms in all documents, different values different ones, and who has the key can invert them. The key comes from
the caller or from a setting of the session; no key is part of this module, none is drawn, and none is written anywhere.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trajecta.llm.common import blocks, released, small_batches

#: The setting that holds the key; by this name Spark leaves it out of what it logs and shows.
SETTING = "spark.trajecta.pii.secret"
ROUNDS = 10
#: Characters that are permuted as one number; longer values go in blocks that are chained, so time stays linear.
BLOCK = 48
#: Days of this range map to days of this range.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

# Month names in English, in the order of the calendar.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_MONTH = "|".join([*(f"{m}|{m[:3]}[.]?" for m in MONTHS), "Sept[.]?"])

#: A text without any of these has no personal data and is passed on as it is.
HINT = r"(?i)[0-9@]|token|secret|passw|api.?key|access.?key|AKIA|gh[pousr]_|sk-|bearer|eyJ|PRIVATE KEY"

PATTERN = re.compile(
    rf"""
    (?P<pem>-----BEGIN[ ](?:[A-Z]+[ ]){{0,3}}PRIVATE[ ]KEY-----(?:[^-]|-(?!----))+-----END[ ](?:[A-Z]+[ ]){{0,3}}PRIVATE[ ]KEY-----)
  | (?P<secret>(?:(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s*[=:]\s*["']?|(?<![A-Za-z])(?i:bearer)[ ]+(?=[^\s"'<>]{{16}}))
        (?P<value>(?=[^\s"'<>]*[^\sA-Za-z"'<>,.;:)])[^\s"'<>]{{5,}}[^\s"'<>,.;:)]|[A-Za-z0-9+/_\-]{{8,}}))
  | (?P<key>(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36,}}|sk-[A-Za-z0-9]{{20,}}|(?=[0-9a-f]*[0-9])[0-9a-f]{{32,64}})(?![A-Za-z0-9]))
  | (?P<email>[\w.+%\u0300-\u036F-]{{1,64}}@(?:[\w\u0300-\u036F-]{{1,63}}\.){{1,8}}[^\W\d_]{{2,24}})
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))
  | (?P<date>(?<![0-9./-])(?:[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}|[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}})(?![0-9]|[./-][0-9])
        |(?<![0-9])[0-9]{{1,2}}[ ](?:{_MONTH})[ ][0-9]{{4}}(?![0-9])|(?<![A-Za-z])(?:{_MONTH})[ ][0-9]{{1,2}},[ ][0-9]{{4}}(?![0-9]))
  | (?P<ipv6>(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{{1,4}}:|:){{2,8}}(?:[0-9A-Fa-f]{{1,4}})?(?![0-9A-Za-z:]|\.[0-9]))
  | (?P<ip>(?<![0-9.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![0-9]|\.[0-9]))
  | (?P<phone>(?<![0-9A-Za-z])(?:\+[0-9]{{1,3}}[ .-]?)?\([0-9]{{2,4}}\)[ .-]?[0-9]{{3,4}}[ .-]?[0-9]{{3,4}}(?![0-9])
        |(?<![0-9A-Za-z])\+[0-9]{{1,3}}(?:[ .-]?[0-9]{{2,4}}){{2,5}}(?![0-9])|(?<![0-9A-Za-z-])[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}(?![0-9-])
        |(?<![0-9A-Za-z.,-])[2-9][0-9]{{2}}[2-9][0-9]{{6}}(?![0-9A-Za-z-]|[.,][0-9]))
  | (?P<ssn>(?<![0-9-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9-]))
  | (?P<number>(?<![0-9])[0-9]{{4}}(?:[ -][0-9]{{4}}){{2,3}}(?:[ -][0-9]{{1,4}})?(?![0-9])|(?<![0-9])[0-9]{{13,19}}(?![0-9]))
    """,
    re.X,
)


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: a balanced Feistel network on the next even number of bits, walked until it
    comes back into the range."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8

    def mix(k: int, x: int) -> int:
        out = b""
        while len(out) < width:
            out += hashlib.blake2b(b"%d|%d|" % (k, len(out)) + tweak.encode() + b"|" + x.to_bytes(width, "big"), key=key[:64], digest_size=min(64, width)).digest()
        return int.from_bytes(out[:width], "big") & mask

    while True:
        left, right = value >> half, value & mask
        for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if back:
                left, right = right ^ mix(k, left), left
            else:
                left, right = right, left ^ mix(k, right)
        value = left << half | right
        if value < size:
            return value


# The ASCII alphabets within which a character is moved.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]


@lru_cache(maxsize=8192)
def alphabet(c: str) -> str | None:
    """The characters that c may become: an ASCII alphabet, or beyond ASCII the letters, marks or numbers of its category
    in its page of 256 code points (so Cyrillic stays Cyrillic and capitals stay capitals). None if c stays."""
    if c < "\x80":
        return next((a for a in ALPHABETS if c in a), None)
    kind, page = unicodedata.category(c), ord(c) & ~255
    if kind[0] not in "LMN":
        return None
    others = [chr(x) for x in range(max(page, 128), page + 256) if unicodedata.category(chr(x))[0] == kind[0]]
    alike = [x for x in others if unicodedata.category(x) == kind]
    return "".join(alike if len(alike) > 3 else others)


def permute_text(text: str, key: bytes, tweak: str, alphabets: list[str] | None = None, back: bool = False) -> str:
    """Each character stays in its alphabet, those without one stay as they are; the characters are permuted together.

    A long text goes in blocks: once from its start and once from its end, each block under a digest of what the blocks
    before it became, so every character depends on all, and a copy with the key can still go back.
    """
    places = [(i, a) for i, c in enumerate(text) if (a := alphabet(c) if alphabets is None else next((x for x in alphabets if c in x), None)) is not None]
    own = [a for _, a in places]
    digits = [a.index(text[i]) for i, a in places]
    shape = f"{tweak}|{''.join(str(ALPHABETS.index(a)) if a in ALPHABETS else f'<{ord(a[0]):x}.{len(a)}>' for a in own)}"

    def move(a: int, b: int, under: str) -> None:
        number, size = 0, 1
        for k in range(a, b):
            number, size = number * len(own[k]) + digits[k], size * len(own[k])
        number = permute(number, size, key, under, back)
        for k in range(b - 1, a - 1, -1):
            number, digits[k] = divmod(number, len(own[k]))

    if len(places) <= BLOCK:
        move(0, len(places), shape)
    else:
        cuts = [(a, min(a + BLOCK, len(places))) for a in range(0, len(places), BLOCK)]
        shape = hashlib.blake2b(shape.encode(), digest_size=16).hexdigest()
        passes = [("on", cuts), ("off", cuts[::-1])]
        for name, order in reversed(passes) if back else passes:
            chain = hashlib.blake2b(f"{name}|{shape}".encode(), digest_size=16).digest()
            for a, b in order:
                before = digits[a:b]
                move(a, b, chain.hex())
                # the digest is of what the block became: on the way back, that is what it was
                chain = hashlib.blake2b(chain + repr(before if back else digits[a:b]).encode(), digest_size=16).digest()
    out = list(text)
    for (i, a), d in zip(places, digits, strict=True):
        out[i] = a[d]
    return "".join(out)


def luhn_digit(digits: str) -> str:
    """The check digit that belongs after these digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _in_place(text: str, digits: str) -> str:
    source = iter(digits)
    return re.sub("[0-9]", lambda _: next(source), text)


def number(text: str, key: bytes, back: bool = False) -> str:
    """Card and account numbers; a valid check digit stays valid."""
    digits = re.sub("[^0-9]", "", text)
    if luhn_digit(digits[:-1]) == digits[-1]:
        body = permute_text(digits[:-1], key, "luhn", back=back)
        return _in_place(text, body + luhn_digit(body))
    # the numbers without a valid check digit: their own permutation, walked past the valid ones
    while True:
        digits = permute_text(digits, key, "number", back=back)
        if luhn_digit(digits[:-1]) != digits[-1]:
            return _in_place(text, digits)


def _walked(digits: str, key: bytes, tweak: str, valid: Callable[[str], bool], back: bool) -> str | None:
    """The permutation of valid numbers of so many digits; None for one that isn't valid."""
    if not valid(digits):
        return None
    while True:
        digits = permute_text(digits, key, tweak, back=back)
        if valid(digits):
            return digits


def ssn(text: str, key: bytes, back: bool = False) -> str | None:
    """Only numbers that can be given: no area 000, 666 or from 900 on, no group 00, no serial 0000."""
    moved = _walked(re.sub("[^0-9]", "", text), key, "ssn", lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000", back)
    return moved and _in_place(text, moved)


def phone(text: str, key: bytes, back: bool = False) -> str | None:
    """The country code stays. Ten digits without any sign only where area and exchange can be dialled, which stays so."""
    if text.isdigit():
        return _walked(text, key, "phone10", lambda d: d[0] > "1" and d[3] > "1" and d[1:3] != "11" and d[4:6] != "11", back)
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    head = code[0] if code else ""
    return head + permute_text(text[len(head) :], key, f"phone{head}", back=back)


def ip(text: str, key: bytes, back: bool = False) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255:
        return None
    moved = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, moved.to_bytes(4, "big")))


def ipv6(text: str, key: bytes, back: bool = False) -> str | None:
    """Every spelling of an address moves to the shortest spelling of one other address; capitals stay capitals. What has
    no digit is rather a name in a program, and the first 2^32 addresses are of this machine or mean none: these stay."""

    def valid(address: ipaddress.IPv6Address) -> bool:
        return int(address) >> 32 > 0 and any(c.isdigit() for c in str(address))

    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if not valid(address):
        return None
    while True:
        address = ipaddress.IPv6Address(permute(int(address), 1 << 128, key, "ipv6", back))
        if valid(address):
            return str(address).upper() if text != text.lower() else str(address)


def pem(text: str, key: bytes, back: bool = False) -> str:
    """The lines between the marks of a private key."""
    begin, end = text.index("-----", 10) + 5, text.rindex("-----END")
    return text[:begin] + permute_text(text[begin:end], key, "pem", back=back) + text[end:]


def _day(year: int, month: int, day: int) -> int | None:
    try:
        n = dt.date(year, month, day).toordinal()
    except ValueError:
        return None
    return n if FIRST_DAY <= n <= LAST_DAY else None


def date(text: str, key: bytes, back: bool = False) -> str | None:
    """A day of 1900 to 2099 moves to another one that is written alike: the order of fields, leading zeros, month names.

    It is walked on until the new day can be written so: without zeros only if a field has one digit, as before; with
    the month first only if the day is over 12, as else it would be read the other way. So every spelling goes back.
    """
    fields = re.findall(r"[0-9]+|[A-Za-z]+", text)
    named = next((k for k, x in enumerate(fields) if x[0].isalpha()), None)
    if named is not None:
        month = next(k for k, m in enumerate(MONTHS, 1) if fields[named][:3] == m[:3])
        orders = [{"m": named, "d": 1 - named, "y": 2}]
    else:
        month = 0
        orders = [{"y": 0, "m": 1, "d": 2}] if len(fields[0]) == 4 else [{"d": 0, "m": 1, "y": 2}, {"m": 0, "d": 1, "y": 2}]
    for at in orders:
        n = _day(int(fields[at["y"]]), month or int(fields[at["m"]]), int(fields[at["d"]]))
        if n is None:
            continue
        written = {x: fields[at[x]] for x in "dm" if at[x] != named}
        short, zero = [any(len(f) == 1 for f in written.values()), any(f[0] == "0" for f in written.values())]
        month_first = at["m"] == 0 and named is None
        while True:
            n = FIRST_DAY + permute(n - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date" + "".join(sorted(at, key=at.get)), back)
            moved = dt.date.fromordinal(n)
            low = [{"d": moved.day, "m": moved.month}[x] < 10 for x in written]
            if (not short or (all(low) if zero else any(low))) and (not month_first or moved.day > 12):
                break
        new = {"y": f"{moved.year:04d}", "m": str(moved.month), "d": str(moved.day)}
        for x, f in written.items():
            new[x] = new[x].zfill(2) if not short or f[0] == "0" else new[x]
        if named is not None:
            full = MONTHS[moved.month - 1]
            new["m"] = full if len(fields[named]) > 3 and fields[named] in MONTHS else full[:3]
        values = iter([new[x] for x in sorted(at, key=at.get)])
        return re.sub(r"[0-9]+|[A-Za-z]+", lambda _: next(values), text)
    return None


def iban(text: str, key: bytes, back: bool = False) -> str | None:
    """Only with valid check digits; they are computed anew."""
    plain = text.replace(" ", "")
    value = lambda s: int("".join(str(int(c, 36)) for c in s))
    if value(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = permute_text(plain[4:], key, f"iban{plain[:2]}", back=back)
    moved = iter(f"{plain[:2]}{98 - value(f'{body}{plain[:2]}00') % 97:02d}{body}")
    return "".join(c if c == " " else next(moved) for c in text)


HEX = ["0123456789abcdef", "0123456789ABCDEF"]


def secret(text: str, key: bytes, back: bool = False) -> str:
    """Tokens: hexadecimal ones within their digits, others by the class of each character."""
    for digits in HEX:
        if len(text) >= 16 and set(text) <= set(digits):
            return permute_text(text, key, "hex", [digits], back)
    return permute_text(text, key, "secret", back=back)


def email(text: str, key: bytes, back: bool = False) -> str:
    """The local part and the domain each move as a whole, so people of one domain stay together; the last label stays."""
    local, _, domain = text.rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{permute_text(local, key, 'local', back=back)}@{permute_text(host, key, 'host', back=back)}.{top}"


KINDS: dict[str, Callable[..., str | None]] = {"date": date, "email": email, "iban": iban, "ip": ip, "ipv6": ipv6, "number": number, "pem": pem, "phone": phone, "ssn": ssn, "key": secret}


def secret_key(spark: SparkSession) -> bytes:
    """The key named by the setting. There is no other: a key drawn here would be lost with the application, and with it
    the links between what it and the next one wrote."""
    named = spark.conf.get(SETTING, None)
    if not named:
        raise ValueError(f"pseudonyms need a key: set {SETTING}, or pass one")
    return named.encode()


def pseudonyms(text: str, key: bytes) -> tuple[str, list[str]]:
    """The text with its personal data moved, and the kinds found, in order. A value that isn't valid for its kind
    (an octet over 255, no such day) stays."""
    kinds: list[str] = []

    def one(m: re.Match) -> str:
        kind = m.lastgroup if m.lastgroup != "value" else "secret"
        if m["secret"]:
            kinds.append("secret")
            at = m.start("value") - m.start()
            return m[0][:at] + secret(m["value"], key)
        moved = KINDS[kind](m[0], key)
        if moved is None:
            return m[0]
        kinds.append(kind)
        return moved

    return PATTERN.sub(one, text), kinds


def protect(docs: DataFrame, key: bytes | None = None, report: bool = False) -> DataFrame:
    """The same rows and columns with pseudonyms in `text`; null and empty texts stay, and so does every other column,
    also one named like a result. Rows that repeat a doc_id each keep their row. With report: also n_values (long) and
    kinds (distinct, sorted, comma-joined) in place of all columns but doc_id and text. key: by default secret_key(),
    which raises where none is set."""
    small_batches(docs.sparkSession)
    key = secret_key(docs.sparkSession) if key is None else key
    docs = docs.select("doc_id", "text") if report else docs
    names = docs.columns
    place = names.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_values", T.LongType()), T.StructField("kinds", T.StringType())]) if report else docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 2_000_000):
            texts = batch.column(place)
            likely = pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_numpy(zero_copy_only=False)
            found: dict[int, list[str]] = {}
            if likely.any():
                out = texts.to_pylist()
                for k in likely.nonzero()[0]:
                    out[k], kinds = pseudonyms(out[k], key)
                    if kinds:
                        found[k] = kinds
                if found:
                    texts = pa.array(out, texts.type)
            columns = [texts if k == place else batch.column(k) for k in range(len(names))]
            if report:
                n = range(batch.num_rows)
                columns += [pa.array([len(found.get(k, ())) for k in n], pa.int64()), pa.array([",".join(sorted(set(found.get(k, ())))) for k in n], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(released(run), schema)
