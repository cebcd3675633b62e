"""Nested records to entities of the graph, and runs that take the place of earlier ones."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..session import small_batches

# Words of field names by the kind of entity a value there names, and fields that name none.
LOCATIONS = ("jurisdiction", "country", "address", "city", "state", "province", "region", "location", "place_of_birth", "issuing_country")
DATES = ("date", "expiry", "expiration", "issued", "dob", "birth", "due", "period", "valid", "effective", "start", "end", "deadline", "maturity")
MONEY = (
    "amount", "total", "price", "subtotal", "tax", "fee", "balance", "cost", "salary", "premium", "charge", "payment", "discount", "grand_total", "sum", "principal", "interest", "deposit", "rent", "revenue",
    "income", "expense",
)
IDENTIFIERS = ("number", "_no", "_id", "reference", "sku", "account", "iban", "passport", "license", "registration", "serial", "policy", "claim", "tracking", "barcode", "doi", "isbn")
PARTIES = (
    "name", "vendor", "seller", "buyer", "customer", "issuer", "holder", "patient", "author", "payee", "payer", "merchant", "employer", "employee", "landlord", "tenant", "recipient", "applicant", "owner",
    "director", "shareholder", "insured", "physician", "supplier", "consignee", "shipper", "beneficiary", "subject", "party", "signatory", "organization", "organisation", "company", "manufacturer", "provider",
    "client", "borrower", "lender", "guarantor", "witness", "authority", "agent", "broker", "officer",
)
SKIPPED = (
    "parties", "key_facts", "identifiers", "amounts", "dates", "records", "tags", "field_bboxes", "field_confidence", "field_mentions", "detected_doc_type", "detected_doc_subtype", "key_text_points", "title",
    "description", "summary", "confidence",
)
ORGANISATIONS = (" PTE", " LTD", " LIMITED", " INC", " LLC", " GMBH", " CORP", " PLC", " COMPANY", " BANK", " GROUP", " HOLDINGS", " AG", " SA", " BV", " NV")
# Relations from a document to what it names, by kind.
RELATIONS = {"person": "is_party_to", "org": "is_party_to", "date": "dated", "money": "has_total", "location": "governed_by", "identifier": "has_identifier"}


def leaves(docs: DataFrame, fields: str = "fields", depth: int = 8, items: int = 40, whole: bool = False) -> DataFrame:
    """(doc, field, value): the strings of nested records, each under the nearest field name above it; if ``whole`` a row for each record, its other columns and ``found`` with the values of fields that name a kind, and that kind.

    An object that has a name, or else a value, that is a string stands for that string; of an array the
    first ``items`` entries count.  A record is parsed and read where it stands, ``depth`` levels at most, so
    nothing is shuffled or written; numbers, flags, broken records and the SKIPPED fields name nothing.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != fields] if whole else ["doc"]
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in others]
    skipped = frozenset(SKIPPED)

    def read(v: dict | list, above: str, left: int, out: list[tuple[str, str]]) -> None:
        for key, x in v.items() if isinstance(v, dict) else ((None, x) for x in v[:items]):
            if key in skipped:
                continue
            field = above if key is None else key
            if isinstance(x, str):
                out.append((field, x))
            elif isinstance(x, dict):
                said = key is not None and next((t for t in (x.get("name"), x.get("value")) if isinstance(t, str) and t.strip(" ")), None)
                if said:
                    out.append((field, said.strip(" ")))
                elif left > 1:
                    read(x, field, left - 1, out)
            elif isinstance(x, list) and key is not None and left > 1:  # a list within a list is not looked into
                read(x, field, left - 1, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda x: pa.array([t if t.isascii() else t.encode("utf-8", "replace").decode() for t in x], pa.string())
        decode = json.JSONDecoder(parse_int=len, parse_float=len, strict=False).raw_decode  # numbers name nothing
        for batch in batches:
            found, sizes = [], []
            for text in batch.column(len(others)).to_pylist():
                before, v = len(found), decode(text.lstrip(" \t\r\n\ufeff"))[0]
                if isinstance(v, (dict, list)):
                    read(v, "", depth, found)
                sizes.append(len(found) - before)
            if whole:
                kind = [said_kind(f) for f, _ in found]
                held = np.array([k is not None for k in kind], bool)
                told = pa.StructArray.from_arrays([pa.array([k for k in kind if k], pa.string()), plain(t for (_, t), k in zip(found, kind) if k)], ["kind", "value"])
                ends = np.append(0, np.cumsum(held))[np.append(0, np.cumsum(np.array(sizes, int)))]
                yield pa.record_batch([*batch.columns[: len(others)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told)], [*others, "found"])
                continue
            at = np.repeat(np.arange(batch.num_rows), np.array(sizes, int))
            yield pa.record_batch([batch.column(0).take(pa.array(at)), plain(f for f, _ in found), plain(t for _, t in found)], ["doc", "field", "value"])

    # What Spark cannot parse is broken, whatever Python makes of it.  A filter would be pushed down and have the text made again.
    sound = docs.select(*others, F.explode(F.filter(F.array(fields), lambda x: F.try_parse_json(x).isNotNull())).alias("_fields"))
    return sound.mapInArrow(run, ", ".join([*kinds, "found array<struct<kind:string,value:string>>" if whole else "field string, value string"]))


KINDS = {"location": LOCATIONS, "date": DATES, "money": MONEY, "identifier": IDENTIFIERS, "party": PARTIES}


@functools.lru_cache(10_000)
def said_kind(field: str) -> str | None:
    """As ``kind_of``; a field that many records have is looked at once."""
    return next((kind for kind, words in KINDS.items() if any(w in field.lower() for w in words)), None)


def kind_of(field: Column) -> Column:
    """location, date, money, identifier or party by the words in a field's name, the narrower first."""
    has = lambda low, words: low.rlike("|".join(words))
    return names.let(F.lower(field), lambda low: F.when(has(low, LOCATIONS), "location").when(has(low, DATES), "date").when(has(low, MONEY), "money").when(has(low, IDENTIFIERS), "identifier").when(has(low, PARTIES), "party"))


def entities(found: DataFrame) -> DataFrame:
    """(doc, kind, canonical, text, roles) of the ``leaves`` of records; joint holders are one entity each.

    Kind, parts and canonical form are each exploded out of an array: so they are computed once, where a
    filter on them would be pushed down and have them computed again.
    """
    once = lambda c, keep: F.explode(F.filter(F.array(c), keep))
    long = found.filter("length(value) >= 2").select("doc", "field", F.trim("value").alias("value")).filter("value <> ''")
    kinds = long.select("doc", "field", "value", once(kind_of(F.col("field")), lambda k: k.isNotNull()).alias("kind"))
    parts = kinds.select("doc", "field", "kind", F.explode(_parts(F.col("kind"), F.col("value"))).alias("x"))
    parts = parts.select("doc", "field", F.col("x.text").alias("text"), once(_kind(F.col("kind"), F.col("x")), lambda k: F.lit(True)).alias("kind"))
    named = parts.select("doc", "field", "text", "kind", once(_canonical(F.col("kind"), F.col("text")), lambda x: x != "").alias("canonical"))
    return named.groupBy("doc", "kind", "canonical").agg(F.min("text").alias("text"), F.array_sort(F.collect_set("field")).alias("roles"))


def _parts(kind: Column, value: Column) -> Column:
    """The holders a value of a party names, or the value alone."""
    part = lambda text, joint: F.struct(text.alias("text"), joint.alias("joint"))
    people = names.let(names.split_people(value), lambda p: F.transform(p, lambda x: part(x, F.size(p) > 1)))
    return F.when(kind == "party", people).otherwise(F.array(part(value, F.lit(False))))


def _kind(kind: Column, x: Column) -> Column:
    """org or person for a party, else the kind."""
    org = ~x["joint"] & names.let(F.concat(F.lit(" "), F.upper(x["text"])), lambda upper: F.exists(F.array(*map(F.lit, ORGANISATIONS)), lambda t: F.contains(upper, t)))
    return F.when(kind != "party", kind).when(org, "org").otherwise("person")


def _canonical(kind: Column, text: Column) -> Column:
    return (
        F.when(kind == "org", names.canon_org(text)).when(kind == "person", names.canon_name_sorted(text)).when(kind == "date", names.canon_date(text))
        .when(kind == "money", names.money_canonical(text)).when(kind == "identifier", names.norm_alnum(text)).otherwise(F.lower(text))
    )


def entities_in(records: DataFrame) -> DataFrame:
    """The columns of ``records`` but ``found``, kind and canonical: as ``entities`` of ``leaves`` that are ``whole``, each once a record, where the record stands: nothing is shuffled."""
    let = names.let
    # Joined to one text each, so that telling them apart takes no pairs.
    told = lambda kind, text: F.concat(kind, F.lit("\0"), _canonical(kind, text))
    of = lambda kind, value: F.transform(_parts(kind, value), lambda x: let(_kind(kind, x), lambda k: told(k, x["text"])))
    each = lambda x: let(F.trim(x["value"]), lambda value: of(x["kind"], value))
    said = F.filter("found", lambda x: (F.length(x["value"]) >= 2) & (F.trim(x["value"]) != ""))
    named = F.array_distinct(F.filter(F.flatten(F.transform(said, each)), lambda x: ~x.endswith("\0")))
    out = records.select(*(c for c in records.columns if c != "found"), F.explode(named).alias("_x"))
    at = F.instr("_x", "\0")
    return out.select("*", F.col("_x").substr(F.lit(1), at - 1).alias("kind"), F.col("_x").substr(at + 1, F.length("_x")).alias("canonical")).drop("_x")


def relations(found: DataFrame) -> DataFrame:
    """(doc, rel, kind, canonical) from each document to its entities."""
    known = F.create_map(*(F.lit(x) for pair in RELATIONS.items() for x in pair))
    return found.select("doc", known[F.col("kind")].alias("rel"), "kind", "canonical")


def run_again(found: DataFrame, again: Column) -> DataFrame:
    """``found`` with run and deprecated_by after a first run over all documents and a second over those marked ``again``: as two of ``refreshed`` leave it, without a join."""
    row = lambda run, by: F.struct(F.lit(run).alias("run"), by.cast("int").alias("deprecated_by"))
    runs = F.when(again, F.array(row(1, F.lit(2)), row(2, F.lit(None)))).otherwise(F.array(row(1, F.lit(None))))
    return found.select("*", F.inline(runs))


def refreshed(earlier: DataFrame, docs: DataFrame, found: DataFrame, run: int) -> DataFrame:
    """``earlier`` (doc, kind, canonical, text, roles, run, deprecated_by) after a run over ``docs`` (doc).

    What earlier runs found in these documents stays, marked as deprecated by this run; other documents'
    entities and earlier marks are left as they are; what the run found is added.
    """
    asked = docs.select("doc").distinct().withColumn("_again", F.lit(run))
    old = earlier.join(asked, "doc", "left").withColumn("deprecated_by", F.coalesce("deprecated_by", "_again")).drop("_again")
    return old.unionByName(found.withColumn("run", F.lit(run)).withColumn("deprecated_by", F.lit(None).cast("int")))
