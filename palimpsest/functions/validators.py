"""Checksum and shape validators as Column expressions: name → function of the matched string."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Validator = Callable[[Column], Column]
L = F.lit


def _only(s: Column, drop: str = r"[\s-]") -> Column:
    return F.regexp_replace(s, drop, "")


def _digit(s: Column, at: int) -> Column:
    """The digit at a 1-based place; null where there is none."""
    return F.try_to_number(F.substring(s, at, 1), L("9")).cast("int")


def _weighted(s: Column, weights: Sequence[int], start: int = 1) -> Column:
    total = L(0)
    for i, w in enumerate(weights):
        if w:
            total = total + F.coalesce(_digit(s, start + i), L(0)) * w
    return total


def _luhn_sum(digits: Column) -> Column:
    value = lambda c, i: F.when(F.pmod(i, L(2)) == 1, F.when(c > 4, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    places = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c.rlike("^[0-9]$")), lambda c, i: value(c.cast("int"), i))
    return F.aggregate(places, L(0), lambda a, c: (a + c).cast("int"))


def _shaped(s: Column, pattern: str, test: Column) -> Column:
    return F.when(s.rlike(pattern), test).otherwise(L(False))


def luhn(s: Column) -> Column:
    d = _only(s)
    return _shaped(d, r"^[0-9]+$", _luhn_sum(d) % 10 == 0)


def iban_mod97(s: Column) -> Column:
    d = F.upper(_only(s, r"\s"))
    moved = F.concat(F.substr(d, L(5)), F.substring(d, 1, 4))
    step = lambda a, c: F.when(c == "", a).otherwise(F.pmod(F.when(F.ascii(c) >= 65, a * 100 + F.ascii(c) - 55).otherwise(a * 10 + F.ascii(c) - 48), L(97)).cast("int"))
    return _shaped(d, r"^[A-Z0-9]{5,34}$", F.aggregate(F.split(moved, ""), L(0), step) == 1)


def ip_octets(s: Column) -> Column:
    parts = F.split(s, r"\.")
    return _shaped(s, r"^[0-9]{1,3}(?:\.[0-9]{1,3})*$", F.forall(parts, lambda p: F.try_to_number(p, L("999")) <= 255))


def nino(s: Column) -> Column:
    d = F.upper(_only(s))
    return d.rlike(r"^(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]")


def nhs(s: Column) -> Column:
    d = _only(s)
    check = F.pmod(11 - _weighted(d, range(10, 1, -1)) % 11, L(11))
    return _shaped(d, r"^[0-9]{10}$", (check != 10) & (check == _digit(d, 10)))


def uk_driving_licence(s: Column) -> Column:
    d = _only(s)
    month = F.pmod(_weighted(d, (10, 1), 7), L(50))
    day = _weighted(d, (10, 1), 9)
    raw = _weighted(d, (10, 1), 7)
    return _shaped(d, r"^.{5}[0-9]{6}.{5}$", F.when(raw > 50, month.between(1, 12)).otherwise(raw.between(1, 12)) & day.between(1, 31))


def pesel(s: Column) -> Column:
    return _shaped(s, r"^[0-9]{11}$", (10 - _weighted(s, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)) % 10) % 10 == _digit(s, 11))


def pl_id_card(s: Column) -> Column:
    d = F.upper(_only(s, r"\s"))
    letters = L(0)
    for at, w in ((1, 7), (2, 3), (3, 1)):
        letters = letters + (F.ascii(F.substring(d, at, 1)) - 55) * w
    return _shaped(d, r"^[A-Z]{3}[0-9]{6}$", (letters + _weighted(d, (0, 7, 3, 1, 7, 3), 4)) % 10 == _digit(d, 4))


def nip(s: Column) -> Column:
    d = _only(s)
    return _shaped(d, r"^[0-9]{10}$", _weighted(d, (6, 5, 7, 2, 3, 4, 5, 6, 7)) % 11 == _digit(d, 10))


def regon(s: Column) -> Column:
    short = _weighted(s, (8, 9, 2, 3, 4, 5, 6, 7)) % 11 % 10 == _digit(s, 9)
    long = _weighted(s, (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)) % 11 % 10 == _digit(s, 14)
    return F.when(s.rlike("^[0-9]{9}$"), short).when(s.rlike("^[0-9]{14}$"), long).otherwise(L(False))


def _swedish(s: Column, coordinated: bool) -> Column:
    d = _only(s, r"[\s+-]")
    ten = F.substr(d, F.greatest(F.length(d) - 9, L(1)))
    day = _weighted(ten, (10, 1), 5)
    return _shaped(d, r"^[0-9]{10,}$", (day >= 61 if coordinated else day < 61) & (_luhn_sum(ten) % 10 == 0))


def personnummer(s: Column) -> Column:
    return _swedish(s, False)


def samordningsnummer(s: Column) -> Column:
    return _swedish(s, True)


def dea(s: Column) -> Column:
    d = F.upper(s)
    total = _weighted(d, (1, 2, 1, 2, 1, 2), 3)
    return _shaped(d, r"^[ABCDEFGHJKLMPRSTUX][A-Z][0-9]{7}$", total % 10 == _digit(d, 9))


def npi(s: Column) -> Column:
    return _shaped(s, r"^[0-9]{10}$", _luhn_sum(F.concat(L("80840"), s)) % 10 == 0)


def aba(s: Column) -> Column:
    return _shaped(s, r"^[0-9]{9}$", _weighted(s, (3, 7, 1) * 3) % 10 == 0)


def nir(s: Column) -> Column:
    d = _only(s, r"\s")
    body = F.when(d.rlike("^[0-9]{15}$"), F.substring(d, 1, 13)).cast("long")
    return _shaped(d, r"^[12][0-9]{14}$", 97 - body % 97 == _weighted(d, (10, 1), 14))


def dni(s: Column) -> Column:
    d = F.upper(_only(s))
    number = F.when(d.rlike("^[0-9]{8}[A-Z]$"), F.substring(d, 1, 8)).cast("int")
    return _shaped(d, r"^[0-9]{8}[A-Z]$", F.substr(L("TRWAGMYFPDXBNJZSQVHLCKE"), number % 23 + 1, L(1)) == F.substring(d, 9, 1))


#: What a character at an odd place of an Italian fiscal code counts, 0-9 then A-Z.
ODD_PLACES = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)


def codice_fiscale(s: Column) -> Column:
    d = F.upper(s)
    place = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    odd = F.array(*map(L, ODD_PLACES))
    even = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 65).otherwise(F.ascii(c) - 48)
    values = F.transform(F.split(F.substring(d, 1, 15), ""), lambda c, i: F.when(c == "", 0).when(i % 2 == 0, F.get(odd, place(c))).otherwise(even(c)))
    total = F.aggregate(values, L(0), lambda a, c: (a + c).cast("int"))
    return _shaped(d, r"^[A-Z0-9]{15}[A-Z]$", total % 26 == F.ascii(F.substring(d, 16, 1)) - 65)


def partita_iva(s: Column) -> Column:
    d = F.regexp_replace(F.upper(_only(s, r"\s")), "^IT", "")
    return _shaped(d, r"^[0-9]{11}$", _luhn_sum(d) % 10 == 0)


def bsn(s: Column) -> Column:
    total = _weighted(s, (9, 8, 7, 6, 5, 4, 3, 2)) - F.coalesce(_digit(s, 9), L(0))
    return _shaped(s, r"^[0-9]{9}$", (total > 0) & (total % 11 == 0))


def nif(s: Column) -> Column:
    rest = _weighted(s, range(9, 1, -1)) % 11
    return _shaped(s, r"^[125689][0-9]{8}$", F.when(rest < 2, 0).otherwise(11 - rest) == _digit(s, 9))


def fodselsnummer(s: Column) -> Column:
    d = _only(s)
    first = F.pmod(11 - _weighted(d, (3, 7, 6, 1, 8, 9, 4, 5, 2)) % 11, L(11))
    second = F.pmod(11 - _weighted(d, (5, 4, 3, 2, 7, 6, 5, 4, 3, 2)) % 11, L(11))
    return _shaped(d, r"^[0-9]{11}$", (_weighted(d, (10, 1)) < 41) & (first == _digit(d, 10)) & (second == _digit(d, 11)))


def d_nummer(s: Column) -> Column:
    d = _only(s)
    return _shaped(d, r"^[0-9]{11}$", _weighted(d, (10, 1)).between(41, 71))


def belgian_nrn(s: Column) -> Column:
    d = _only(s, r"[^0-9]")
    body = F.when(d.rlike("^[0-9]{11}$"), F.substring(d, 1, 9)).cast("long")
    check = _weighted(d, (10, 1), 10)
    return _shaped(d, r"^[0-9]{11}$", (97 - body % 97 == check) | (97 - (body + 2_000_000_000) % 97 == check))


def svnr(s: Column) -> Column:
    d = _only(s, r"\s")
    total = _weighted(d, (3, 7, 9, 0, 5, 8, 4, 2, 1, 6)) % 11
    return _shaped(d, r"^[1-9][0-9]{9}$", (total != 10) & (total == _digit(d, 4)))


def ahv(s: Column) -> Column:
    d = _only(s, r"[\s.]")
    return _shaped(d, r"^756[0-9]{10}$", (10 - _weighted(d, (1, 3) * 6) % 10) % 10 == _digit(d, 13))


def steuer_id(s: Column) -> Column:
    d = _only(s, r"\s")
    # a fold: as one expression each digit would double it
    start = F.aggregate(
        F.array(*[F.coalesce(_digit(d, at), L(0)) for at in range(1, 11)]),
        L(10),
        lambda a, x: F.when((a + x) % 10 == 0, 10).otherwise((a + x) % 10) * 2 % 11,
    )
    return _shaped(d, r"^[1-9][0-9]{10}$", (11 - start) % 10 == _digit(d, 11))


def hetu(s: Column) -> Column:
    d = F.upper(s)
    number = F.when(d.rlike(r"^[0-9]{6}[-+A-Z][0-9]{3}.$"), F.concat(F.substring(d, 1, 6), F.substring(d, 8, 3))).cast("int")
    return _shaped(d, r"^[0-9]{6}[-+A-Z][0-9]{3}[0-9A-Y]$", F.substr(L("0123456789ABCDEFHJKLMNPRSTUVWXY"), number % 31 + 1, L(1)) == F.substring(d, 11, 1))


def pps(s: Column) -> Column:
    d = F.upper(_only(s, r"\s"))
    suffix = F.substring(d, 9, 1)
    more = F.when((suffix == "") | (suffix == "W"), 0).otherwise((F.ascii(suffix) - 64) * 9)
    rest = (_weighted(d, range(8, 1, -1)) + more) % 23
    return _shaped(d, r"^[0-9]{7}[A-W][A-IW]?$", F.when(rest == 0, "W").otherwise(F.char(rest + 64)) == F.substring(d, 8, 1))


def shannon_entropy(s: Column) -> Column:
    """Bits per character; 0 for the empty string."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    share = lambda c: (F.length(s) - F.length(F.replace(s, c, L("")))) / F.length(s)
    return F.aggregate(F.array_distinct(chars), L(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def secret_assignment(s: Column) -> Column:
    value = F.regexp_replace(F.regexp_replace(F.regexp_extract(s, r"^[^:=]*[:=](.*)$", 1), r"^[>\s\"'=]+", ""), r"[\"'\s]*=*$", "")
    bits = shannon_entropy(value)
    return (F.length(value) >= 16) & ~value.rlike("^[0-9]+$") & F.when(value.rlike("^[0-9a-fA-F]+$"), bits >= 3.0).otherwise(bits >= 4.0)


def high_entropy_token(s: Column) -> Column:
    value = F.regexp_replace(s, "=+$", "")
    return F.length(value).between(40, 256) & value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]") & (shannon_entropy(value) >= 4.5)


VALIDATORS: dict[str, Validator] = {
    f.__name__: f
    for f in (
        luhn, iban_mod97, ip_octets, nino, nhs, uk_driving_licence, pesel, pl_id_card, nip, regon, personnummer, samordningsnummer, dea, npi, aba, nir,
        dni, codice_fiscale, partita_iva, bsn, nif, fodselsnummer, d_nummer, belgian_nrn, svnr, ahv, steuer_id, hetu, pps, secret_assignment, high_entropy_token,
    )
}


def validator(name: str) -> Validator:
    if name not in VALIDATORS:
        raise KeyError(f"unknown validator: {name}")
    return VALIDATORS[name]
