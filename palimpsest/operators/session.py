"""Sessions: numbered placeholders, the reversible map, redaction and restoring, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN = r"\[[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_[0-9]+\]"
#: A placeholder as a model may have mangled it: in brackets in any case and with any separator, or bare in capitals.
MANGLED = r"[*`~]*\[[*`~]*[A-Za-z][A-Za-z0-9 _*`~-]{0,60}[ _-][*`~]*[0-9]+[*`~]*\][*`~]*|(?<![\p{L}\p{N}_\[<])[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_[0-9]+(?![\p{L}\p{N}_])"
BLANK = "________"
MAX_ENTRIES = 10_000


def literal_counters(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The largest number that each type already has in literal placeholders of the texts: key, entity_type, reserved."""
    tokens = documents.select(key, F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("t"))
    digits = F.regexp_extract("t", r"_([0-9]+)\]$", 1)
    return (
        tokens.where(F.length(digits) <= 9)
        .groupBy(key, F.regexp_extract("t", r"^\[(.*)_[0-9]+\]$", 1).alias("entity_type"))
        .agg(F.max(digits.cast("int")).alias("reserved"))
    )


def number_placeholders(spans: DataFrame, key: str = "doc_id", numbering: str = "reading", reserved: DataFrame | None = None) -> DataFrame:
    """The session map of spans (key, type, value, start, end): one placeholder for each distinct value.

    reading: values in order of their first start. reverse: persons first
    (more words first, then first start), then the others from the end of
    the text. Numbers count per key and type, after those ``reserved``.
    Columns key, entity_type, original, replacement, seq.
    """
    first = F.min(F.struct("start", "end", "type"))
    values = spans.groupBy(key, F.col("value").alias("original")).agg(first.alias("f"), F.max("start").alias("last"))
    values = values.withColumn("entity_type", F.col("f.type"))
    if numbering == "reading":
        order = [F.col("f.start"), F.col("f.end"), F.col("original")]
    else:
        person = F.col("entity_type") == "PERSON"
        words = F.size(F.split(F.trim("original"), r"\s+"))
        order = [F.when(person, 0).otherwise(1), F.when(person, -words).otherwise(0), F.when(person, F.col("f.start")).otherwise(-F.col("last")), F.col("original")]
    if reserved is not None:
        values = values.join(reserved, [key, "entity_type"], "left")
    base = F.coalesce("reserved", F.lit(0)) if reserved is not None else F.lit(0)
    n = F.row_number().over(Window.partitionBy(key, "entity_type").orderBy(*order)) + base
    seq = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return values.select(key, "entity_type", "original", F.concat(F.lit("["), "entity_type", F.lit("_"), n.cast("string"), F.lit("]")).alias("replacement"), seq.alias("seq"))


def normalise_replacements(items: Column) -> Column:
    """Array of (start, end, replacement) by start, each start clamped to the end before, covered ones dropped."""
    return F.aggregate(
        F.array_sort(items),
        F.struct(F.lit(0).alias("e"), F.slice(items, 1, 0).alias("k")),
        lambda a, s: F.when(
            s["end"] > a["e"],
            F.struct(s["end"].alias("e"), F.concat(a["k"], F.array(F.struct(F.greatest(s["start"], a["e"]).alias("start"), s["end"].alias("end"), s["replacement"].alias("replacement")))).alias("k")),
        ).otherwise(a),
    )["k"]


def apply_replacements(text: Column, items: Column) -> Column:
    """``text`` with each (start, end, replacement) of normalised items put in: the pieces are made once and joined once."""

    def put(k: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(k, i - 1)["end"]).otherwise(0)
        pieces = F.transform(k, lambda s, i: F.concat(F.substr(text, before(i) + 1, s["start"] - before(i)), s["replacement"]))
        return F.concat(F.array_join(pieces, ""), F.substr(text, F.coalesce(F.get(k, F.size(k) - 1)["end"], F.lit(0)) + 1))

    # bound in a one-element array, so that the items are computed once
    return F.get(F.transform(F.array(items), put), 0)


def redact(documents: DataFrame, spans: DataFrame, mapping: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """doc_id and text with every span replaced: by its placeholder in ``mapping``, or blanked without one.

    A span counts where the text has its value at its place, so rows that
    share a doc_id take their own spans only, and so do rows with a null one.
    Other columns are ignored.
    """
    if mapping is None:
        items = spans.select("doc_id", F.struct("start", "end", F.lit(BLANK).alias("replacement"), "value").alias("i"))
    else:
        keyed = mapping.select(F.col(key).alias("_k"), "original", "replacement")
        items = spans.join(keyed, spans[key].eqNullSafe(F.col("_k")) & (F.col("value") == F.col("original"))).select("doc_id", F.struct("start", "end", "replacement", "value").alias("i"))
    grouped = items.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("i").alias("items"))
    rows = documents.select("doc_id", "text").join(grouped, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    own = F.filter("items", lambda s: F.substr("text", s["start"] + 1, s["end"] - s["start"]) == s["value"])
    plain = F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("replacement")))
    return rows.select("doc_id", F.when(F.col("items").isNull(), F.col("text")).otherwise(apply_replacements(F.col("text"), normalise_replacements(plain))).alias("text"))


def _put_back(text: Column, pattern: str, known: Column, form=lambda h: h) -> Column:
    """``text`` with each hit of ``pattern`` whose form is a key of the map ``known`` replaced by its value."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["gap"], F.coalesce(F.try_element_at(known, form(x["hit"])), x["hit"], F.lit("")))), "")


def restore(documents: DataFrame, mapping: DataFrame, key: str = "doc_id", tolerant: bool = False) -> DataFrame:
    """Replies (key, text) with every known placeholder put back once; restored text isn't searched again.

    tolerant: placeholders that a model has mangled ("[person 1]",
    "**PERSON-1**") are put back too, where only one placeholder of the map
    has that form. Null keys have their own map. Other columns are ignored.
    """
    entry = F.map_from_entries(F.collect_list(F.struct("replacement", "original")))
    maps = mapping.dropDuplicates([key, "replacement"]).groupBy(F.col(key).alias("_k")).agg(entry.alias("_map"))
    rows = documents.select(key, "text").join(maps, F.col(key).eqNullSafe(F.col("_k")), "left")
    if not tolerant:
        return rows.select(key, F.when(F.col("_map").isNull(), F.col("text")).otherwise(_put_back(F.col("text"), TOKEN, F.col("_map"))).alias("text"))
    forms = tolerant_index(mapping.where(F.col("replacement").rlike(f"^{TOKEN}$")), key).join(mapping.select(F.col(key).alias("_k2"), "replacement", "original").distinct(), ["replacement"])
    forms = forms.where(F.col(key).eqNullSafe(F.col("_k2"))).groupBy(F.col("_k2").alias("_k3")).agg(F.map_from_entries(F.collect_set(F.struct("canonical", "original"))).alias("_forms"))
    rows = rows.join(forms, F.col(key).eqNullSafe(F.col("_k3")), "left")
    back = _put_back(F.col("text"), MANGLED, F.col("_forms"), canonical_placeholder)
    return rows.select(key, F.when(F.col("_forms").isNull(), F.col("text")).otherwise(back).alias("text"))


def unresolved_tokens(documents: DataFrame, mapping: DataFrame, key: str = "doc_id") -> DataFrame:
    """Placeholders in the texts that the map doesn't know: key, token."""
    tokens = documents.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))).alias("token"))
    known = mapping.select(F.col(key).alias("_k"), "replacement")
    return tokens.join(known, F.col(key).eqNullSafe(F.col("_k")) & (F.col("token") == F.col("replacement")), "left_anti")


def canonical_placeholder(token: Column) -> Column:
    """The form in which a placeholder mangled by a language model still meets its own: emphasis and edges off, lower case, one separator."""
    plain = F.regexp_replace(token, r"[*`~]", "")
    core = F.regexp_replace(plain, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
    return F.regexp_replace(F.lower(core), r"[^a-z0-9]+", "_")


def canonical_type_prefix(canonical: Column) -> Column:
    """The type of a canonical placeholder ("credit_card" of "credit_card_2"); null for other forms."""
    return F.when(canonical.rlike(r"^[a-z][a-z0-9_]*_[0-9]+$"), F.regexp_replace(canonical, r"_[0-9]+$", ""))


def tolerant_index(mapping: DataFrame, key: str = "doc_id") -> DataFrame:
    """Canonical forms that stand for one placeholder only: key, canonical, replacement."""
    forms = mapping.select(key, "replacement", canonical_placeholder(F.col("replacement")).alias("canonical")).distinct()
    return forms.groupBy(key, "canonical").agg(F.count("*").alias("n"), F.min("replacement").alias("replacement")).where("n = 1").select(key, "canonical", "replacement")


def serialise(mapping: DataFrame, key: str = "doc_id", mode: str = "labeled", salt: str = "") -> DataFrame:
    """The map of each key as JSON: an array of entries, or an object with mode and salt around it; blanked entries are left out."""
    entry = F.struct("seq", F.struct("original", "replacement", "entity_type").alias("e"))
    rows = mapping.where(F.col("replacement") != BLANK).groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_s"))
    entries = F.transform("_s", lambda x: x["e"])
    body = F.to_json(entries) if mode == "labeled" else F.to_json(F.struct(F.lit(mode).alias("mode"), F.lit(salt).alias("salt"), entries.alias("entries")))
    return rows.select(key, body.alias("session"))


def parse(sessions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The map from its JSON, in either form; more than MAX_ENTRIES entries are an error."""
    entries = "array<struct<original:string,replacement:string,entity_type:string>>"
    plain = F.from_json("session", entries)
    wrapped = F.from_json("session", f"struct<mode:string,salt:string,entries:{entries}>")["entries"]
    rows = sessions.withColumn("_e", F.when(F.col("session").startswith("["), plain).otherwise(wrapped))
    checked = F.when(F.size("_e") > MAX_ENTRIES, F.raise_error(F.lit("too many session entries"))).otherwise(F.col("_e"))
    return rows.select(key, F.posexplode(checked).alias("seq", "e")).select(key, "e.entity_type", "e.original", "e.replacement", (F.col("seq") + 1).alias("seq"))


def rename_label(mapping: DataFrame, original: str, new: str, key: str = "doc_id") -> DataFrame:
    """Give one value another placeholder, where no other value of the key has it; a blank one is refused."""
    if not new.strip():
        raise ValueError("a placeholder can't be blank")
    taken = F.max(F.col("replacement") == new).over(Window.partitionBy(key))
    return mapping.withColumn("replacement", F.when((F.col("original") == original) & ~taken, F.lit(new)).otherwise(F.col("replacement")))


def layer_zero(mapping: DataFrame, key: str = "doc_id") -> DataFrame:
    """Values to scrub outside the text: every original, and the words of persons with four characters or more; first comes first."""
    own = mapping.select(key, F.col("original").alias("value"), "replacement", "seq", F.lit(0).alias("rank"))
    words = mapping.where("entity_type = 'PERSON'").select(key, F.explode(F.split("original", r"\s+")).alias("value"), "replacement", "seq", F.lit(1).alias("rank"))
    words = words.where((F.length("value") >= 4) & F.col("value").rlike(r"\p{L}"))
    rows = own.unionByName(words).groupBy(key, F.lower("value").alias("folded")).agg(F.min(F.struct("rank", "seq", "value", "replacement")).alias("f"))
    return rows.select(key, F.col("f.value").alias("value"), F.col("f.replacement").alias("replacement"))
