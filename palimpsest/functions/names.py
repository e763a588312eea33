"""Names: runs of capitalised words, words of persons, variants of a name. Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules whose matches are cut to a name, words a name may hold in lower case, legal forms, short words that are no persons.
SUFFIX_STREETS = ("regex:at:street", "regex:de:street", "regex:ch:street-german", "regex:nl:street", "regex:no:street", "regex:se:street")
PREFIX_STREETS = ("regex:es:street", "regex:pt:street", "regex:it:street", "regex:ch:street-french", "regex:be:street")
COMPANY = r"^regex:(?!cn:)[a-z]{2}:company$"
POSTAL = r"^regex:(?!nl:|cn:|jp:|universal:)[a-z]{2}:postal(?:-city)?$"
CONNECTORS = (
    "de du des la le les et and und & y e i van von der den di da del della dei do dos das of am an im zum zur af av "
    "sp. sp z o.o. o.o o. o ograniczoną odpowiedzialnością akcyjna jawna komandytowa sp.j. sp.k. s.c. s.r.l. s.p.a. s.a.s. s.n.c. mbh "
    "sur sous en bei ob nad pod upon"
).split()
LEGAL_FORMS = (
    "sarl sas sa eurl sci snc sasu gmbh ag kg ohg gbr ug mbh kgaa ev ltd plc llp inc llc corp co lp pllc pc ab hb kb as asa ans da "
    "bv nv vof cv sl slu sau sc srl spa sapa lda sgps spj spk sp zoo"
).split()
SHORT_WORDS = "mr ms dr jr sr st ii iv vi no re cc de du da di des del der den dos das van von".split()


def is_name_rule(detector: str) -> bool:
    return detector in SUFFIX_STREETS + PREFIX_STREETS or bool(re.search(COMPANY, detector) or re.search(POSTAL, detector))


def name_rule(detector: Column) -> Column:
    return detector.isin(*SUFFIX_STREETS, *PREFIX_STREETS) | detector.rlike(COMPANY) | detector.rlike(POSTAL)


def _capital(token: Column) -> Column:
    return token.rlike(r"^[«\"'(]*[\p{Lu}\p{N}&]")


def _connector(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), ",$", "").isin(*CONNECTORS)


def name_run(detector: Column, value: Column) -> Column:
    """(skip, value): the part of a company, street or city match that is a name; null where none is.

    A company keeps its longest ending of at most six words that starts with
    a capital and holds only capitalised words and connectors, and needs a
    legal form and another word. A street is treated alike up to its last two
    words, with three words at most before these. A city after a postal code
    ends at the first word that is neither.
    """
    tokens = F.regexp_extract_all(value, F.lit(r"\S+"), F.lit(0))
    gaps = F.split(value, r"\S+", -1)
    none = F.lit(None).cast("struct<skip:int,value:string>")
    every = F.struct(F.lit(0).alias("skip"), value.alias("value"))
    company = detector.rlike(COMPANY)

    def ending(t: Column) -> Column:
        """t: struct of tokens and gaps, bound once."""
        n = F.size(t["tokens"])
        free = F.when(company, 0).otherwise(2)
        longest = F.when(company, 6).otherwise(3)

        def fits(start: Column) -> Column:
            head = _capital(F.get(t["tokens"], start)) | (start >= n - free)
            inner = F.slice(t["tokens"], start + 2, F.greatest(F.lit(0), n - free - start - 1))
            return head & F.forall(inner, lambda w: _capital(w) | _connector(w))

        starts = F.filter(F.sequence(F.greatest(F.lit(0), n - free - longest), n - 1), lambda i: fits(i))
        first = F.get(starts, 0)
        skip = F.length(F.array_join(F.transform(F.slice(t["tokens"], 1, first), lambda w, i: F.concat(F.get(t["gaps"], i), w)), "")) + F.length(F.get(t["gaps"], first))
        last = F.regexp_replace(F.get(t["tokens"], n - 1), "[.,]", "")
        no_form = last.rlike(r"^\p{Lu}{2,5}$") & ~F.lower(last).isin(*LEGAL_FORMS)
        cut = F.struct(skip.cast("int").alias("skip"), F.substr(value, skip + 1).alias("value"))
        alone = company & (n - first < 2)
        return F.when((n == 0) | first.isNull() | (company & ((n < 2) | no_form)) | alone, none).when(first == 0, every).otherwise(cut)

    def city(t: Column) -> Column:
        n = F.size(t["tokens"])
        first = F.get(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(t["tokens"], i).rlike(r"\p{L}")), 0)
        stop = F.coalesce(F.get(F.filter(F.sequence(first, n - 1), lambda i: (i > first) & ~(_capital(F.get(t["tokens"], i)) | _connector(F.get(t["tokens"], i)))), 0), n)
        last = F.array_max(F.filter(F.sequence(first, stop - 1), lambda i: (i == first) | _capital(F.get(t["tokens"], i))))
        kept = F.array_join(F.transform(F.slice(t["tokens"], 1, last + 1), lambda w, i: F.concat(F.get(t["gaps"], i), w)), "")
        return F.when((n == 0) | first.isNull(), none).when(~_capital(F.get(t["tokens"], first)), none).otherwise(F.struct(F.lit(0).alias("skip"), kept.alias("value")))

    bound = F.array(F.struct(tokens.alias("tokens"), gaps.alias("gaps")))
    return (
        F.when(detector.isin(*PREFIX_STREETS), F.when(value.rlike(r"^[a-z]\.?\s"), none).otherwise(every))
        .when(detector.rlike(POSTAL), F.get(F.transform(bound, city), 0))
        .otherwise(F.get(F.transform(bound, ending), 0))
    )


def person_tokens(name: Column) -> Column:
    """The words of a name in lower case, without the punctuation at their edges."""
    words = F.transform(F.split(F.lower(name), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(words, lambda w: w != "")


def has_token(tokens: Column, word: Column) -> Column:
    """Whether a word or its initial is among the tokens: "j" meets "jan", and the other way round."""
    return F.exists(tokens, lambda t: (t == word) | ((F.length(t) == 1) & word.startswith(t)) | ((F.length(word) == 1) & t.startswith(word)))


def is_token_subset(part: Column, whole: Column) -> Column:
    """Whether every word of ``part`` is in ``whole``, initials included; at least one is a full word."""
    a, b = person_tokens(part), person_tokens(whole)
    full = F.exists(a, lambda t: F.array_contains(b, t) & (F.length(t) > 1))
    return (F.size(a) > 0) & F.forall(a, lambda t: has_token(b, t)) & full


def is_person_variant(a: Column, b: Column) -> Column:
    return is_token_subset(a, b) | is_token_subset(b, a)


def variant_suffix(variant: Column, canonical: Column) -> Column:
    """Where a variant's words stand in the full name: FIRST, LAST, FULL for a longer form, else VAR."""
    v, c = person_tokens(variant), person_tokens(canonical)
    one = F.size(v) == 1
    return (
        F.when(F.size(v) > F.size(c), "FULL")
        .when(one & (F.get(v, 0) == F.get(c, 0)), "FIRST")
        .when(one & (F.get(v, 0) == F.element_at(c, -1)), "LAST")
        .otherwise("VAR")
    )


def match_case(word: Column, sample: Column) -> Column:
    """``word`` all upper or all lower if ``sample`` is, else as it is."""
    letters = sample.rlike(r"\p{L}")
    return F.when(letters & (F.upper(sample) == sample) & (F.length(sample) > 1), F.upper(word)).when(letters & (F.lower(sample) == sample), F.lower(word)).otherwise(word)
