"""Checksum and format checks as column expressions, from the public standards."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths of an IBAN by country (ISO 13616 registry).
IBAN_LENGTHS = dict(
    x.split(":")
    for x in """AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18
    FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27
    MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23
    TN:24 TR:26 UA:29 VA:22 VG:24 XK:20""".split()
)


def _digits(text: Column) -> Column:
    """The digits of a string of digits, as an array of int."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def luhn(text: Column, least: int = 13) -> Column:
    """ISO 7812 check over the digits of a text; false with fewer than ``least`` digits."""
    digits = F.reverse(F.regexp_replace(text, "[^0-9]", ""))
    doubled = F.transform(_digits(digits), lambda d, i: F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9))
    return (F.length(digits) >= least) & (F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0)


def mod97(text: Column) -> Column:
    """ISO 7064 mod 97-10 remainder of upper-case letters and digits, the first four moved to the end."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)
    return F.aggregate(F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), value), F.lit(0), step)


def iban(text: Column) -> Column:
    """Country length and mod 97 of an IBAN without spaces, in upper case."""
    lengths = F.create_map(*[F.lit(v) for k, n in IBAN_LENGTHS.items() for v in (k, int(n))])
    return F.coalesce(F.length(text) == lengths[F.substring(text, 1, 2)], F.lit(False)) & (mod97(text) == 1)


def ean13(digits: Column) -> Column:
    """EAN-13 check of 13 digits."""
    weighted = F.transform(_digits(digits), lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 3))
    return F.aggregate(weighted, F.lit(0), lambda a, d: a + d) % 10 == 0


def swiss_uid(digits: Column) -> Column:
    """Mod 11 check of the nine digits of a UID: weights 5, 4, 3, 2, 7, 6, 5, 4; a check digit of 10 doesn't occur."""
    weights = F.array(*map(F.lit, (5, 4, 3, 2, 7, 6, 5, 4)))
    d = _digits(digits)
    total = F.aggregate(F.zip_with(F.slice(d, 1, 8), weights, lambda a, b: a * b), F.lit(0), lambda a, x: a + x)
    return (11 - total % 11) % 11 == F.element_at(d, 9)


def bic(text: Column) -> Column:
    """ISO 9362 structure: four letters, country, two alphanumerics, an optional branch."""
    return text.rlike(r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$")


def ipv4(text: Column) -> Column:
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return text.rlike(rf"^(?:{octet}\.){{3}}{octet}$")


def ipv6(text: Column) -> Column:
    """RFC 4291 text form, with one run of zeros left out at most, and an optional IPv4 tail."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    plain = F.regexp_replace(text, rf":(?:{octet}\.){{3}}{octet}$", ":0:0")
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    whole = plain.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    short = plain.rlike(r"^(?:(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4})?::(?:(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4})?$") & (groups <= 7)
    return whole | short


def _weighted(digits: Column, weights: Sequence[int]) -> Column:
    """The sum of the first digits of an array, each times its weight."""
    products = F.zip_with(F.slice(digits, 1, len(weights)), F.array(*map(F.lit, weights)), lambda d, w: d * w)
    return F.aggregate(products, F.lit(0), lambda a, x: a + x)


def _modulus(weights: Sequence[int], modulus: int, check: Callable[[Column], Column], first: int = 0) -> Callable[[Column], Column]:
    """A check of the digits of a text: ``check`` of their weighted sum, less ``first``, must be the digit after the weights."""

    def valid(text: Column) -> Column:
        digits = _digits(F.regexp_replace(text, "[^0-9]", ""))
        found = check((_weighted(digits, weights) - first) % modulus)
        return F.coalesce(found == F.get(digits, F.lit(len(weights))), F.lit(False))

    return valid


def _divisible(weights: Sequence[int], modulus: int, first: int = 0) -> Callable[[Column], Column]:
    """A check that the weighted sum of a text's digits, less ``first``, is a multiple."""
    return lambda text: (_weighted(_digits(F.regexp_replace(text, "[^0-9]", "")), weights) - first) % modulus == 0


def verhoeff(text: Column) -> Column:
    """Verhoeff's check, from the dihedral group of order ten and powers of its permutation."""
    times = [[(a + b) % 5 if b < 5 else 5 + (a + b) % 5 for b in range(10)] if a < 5 else [5 + (a - b) % 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
    base, powers = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    for _ in range(7):
        powers.append([powers[-1][base[i]] for i in range(10)])
    group, turned = F.array(*[F.lit(x) for row in times for x in row]), F.array(*[F.lit(x) for row in powers for x in row])
    digits = F.transform(F.reverse(_digits(F.regexp_replace(text, "[^0-9]", ""))), lambda d, i: F.get(turned, i % 8 * 10 + d))
    return F.aggregate(digits, F.lit(0), lambda c, d: F.get(group, c * 10 + d)) == 0


def _letter(number: Column, letters: str) -> Column:
    return F.substr(F.lit(letters), (number % len(letters) + 1).cast("int"), F.lit(1))


def nif(text: Column) -> Column:
    """The letter of a Spanish NIF, or of an NIE whose X, Y or Z stands for 0, 1 or 2."""
    own = F.regexp_replace(F.upper(text), "[^0-9A-Z]", "")
    number = F.regexp_extract(F.concat(F.translate(F.substring(own, 1, 1), "XYZ", "012"), F.substr(own, F.lit(2))), "^([0-9]{8})", 1).try_cast("int")
    return F.coalesce(_letter(number, "TRWAGMYFPDXBNJZSQVHLCKE") == F.substr(own, F.length(own), F.lit(1)), F.lit(False))


def nric(text: Column) -> Column:
    """The letter of a Singaporean NRIC or FIN: one table for S and T, one for F and G, one for M; T and G add 4, M adds 3."""
    kind, digits = F.substring(text, 1, 1), _digits(F.substring(text, 2, 7))
    total = (_weighted(digits, (2, 7, 6, 5, 4, 3, 2)) + F.when(kind.isin("T", "G"), 4).when(kind == "M", 3).otherwise(0)) % 11
    letter = F.when(kind.isin("S", "T"), _letter(total, "JZIHGFEDCBA")).when(kind.isin("F", "G"), _letter(total, "XWUTRQPNMLK")).otherwise(_letter(10 - total, "KLJNPQRTUWX"))
    return F.coalesce(letter == F.substring(text, 9, 1), F.lit(False))


def hetu(text: Column) -> Column:
    """The check character of a Finnish identity code: its nine digits modulo 31."""
    number = F.concat(F.substring(text, 1, 6), F.substring(text, 8, 3)).try_cast("long")
    return F.coalesce(_letter(number, "0123456789ABCDEFHJKLMNPRSTUVWXY") == F.substring(text, 11, 1), F.lit(False))


#: Checks by name.
CHECKS = {
    "luhn": luhn,
    "iban": lambda t: iban(F.upper(F.replace(t, F.lit(" "), F.lit("")))),
    "luhn11": lambda t: luhn(t, least=11),
    "nhs": _modulus(range(10, 1, -1), 11, lambda r: (11 - r) % 11),
    "pesel": _modulus((1, 3, 7, 9, 1, 3, 7, 9, 1, 3), 10, lambda r: (10 - r) % 10),
    "acn": _modulus(range(8, 0, -1), 10, lambda r: (10 - r) % 10),
    "medicare": _modulus((1, 3, 7, 9, 1, 3, 7, 9), 10, lambda r: r),
    "tnin": _modulus(range(13, 1, -1), 11, lambda r: (11 - r) % 10),
    "rrn": _modulus((2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5), 11, lambda r: (11 - r) % 10),
    "abn": _divisible((10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19), 89, 10),
    "tfn": _divisible((1, 4, 3, 7, 5, 8, 6, 9, 10), 11),
    "verhoeff": verhoeff,
    "nif": nif,
    "nric": nric,
    "hetu": hetu,
}
