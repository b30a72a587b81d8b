"""One delivery from its file to a judged mutation plan and the state that its acceptance would leave.

read, route (errors, filters, rejections), map, normalise, fingerprint, compare with
the state, control prices and references, gather issues, judge, plan mutations. Every
step is a function of the library; rows stay in DataFrames, and only one row of
counters reaches the driver, as the policy on creations needs it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.functions import components as parts_of
from veldmark.functions import fingerprint as fp
from veldmark.functions import text, values
from veldmark.functions.components import PriceComponent
from veldmark.functions.filters import RecordFilter, decision
from veldmark.functions.issues import catalogued, signature
from veldmark.functions.transforms import FieldMapping, default_applied, field_of, length_error
from veldmark.operators import delta, issues, judge, prices, publication, references
from veldmark.sources.archive import files_at
from veldmark.sources.delimited import Structure, read_delivery

IDENTITY = ("supplier", "grp", "reference")
#: Where discount codes tell offers apart, in the order of their canonical text.
IDENTITY_WITH_DISCOUNT = ("supplier", "grp", "discount", "reference")
#: The most UTF-16 units of identity parts and references, and of descriptions.
LONGEST_PART, LONGEST_DESCRIPTION = 200, 1000


@dataclass(frozen=True)
class Profile:
    """What is configured for deliveries of one link: mappings have the targets supplier, grp, reference, description, base_price, and perhaps currency and references by type. Percentages are whole numbers or decimals; None for a critical or rejected one is no threshold.

    Version 2 of fingerprints: the article also has article_fields (targets of mappings), prices have the shares of their components, and references have a fingerprint of their own.
    With discount, identities have a fourth part: the target of that name, where an empty code is a value of its own. Errors on critical_fields and on references are critical, and so are those that belong to no mapped field.
    Components are held as one nested list a row, of the delivery and of the state; tolerance (micro-units) is for amounts that are worked out again from their share.
    """

    structure: Structure
    mappings: tuple[FieldMapping, ...]
    filters: tuple[RecordFilter, ...] = ()
    reference_types: tuple[str, ...] = ()
    version: int = 1
    link_currency: str | None = None
    allow_zero: bool = False
    allow_negative: bool = False
    deviation_percent: int | Decimal = 15
    short: int = 50
    long: int = 200
    bulk_percent: int | Decimal = 1
    critical_percent: int | Decimal | None = 1
    rejected_percent: int | Decimal | None = None
    creation_percent: int | Decimal = 1
    critical_fields: tuple[str, ...] = field(default=("base_price",))
    article_fields: tuple[str, ...] = ()
    expected_header: tuple[str, ...] | None = None
    guarded: tuple[str, ...] = ()
    components: tuple[PriceComponent, ...] = ()
    tolerance: int = 10_000
    discount: bool = False

    @property
    def identity(self) -> tuple[str, ...]:
        return IDENTITY_WITH_DISCOUNT if self.discount else IDENTITY

    def __post_init__(self):
        if self.discount and "discount" not in (m.target for m in self.mappings):
            raise ValueError("CONFIG_DISCOUNT_FIELD_MISSING")
        codes = [c.code for c in self.components]
        if len({parts_of.BASE, *codes}) != len(codes) + 1:
            raise ValueError(f"CONFIG_PRICE_COMPONENT_DUPLICATE: {sorted(codes)}")


@dataclass
class Screened:
    """staged: valid rows with classification and mask; issues; groups; counters and judgement: one row each; mutations; notices: issues of the delivery as a whole (code, field, signature, occurrences, and what the catalogue says)."""

    staged: DataFrame
    issues: DataFrame
    groups: DataFrame
    counters: DataFrame
    judgement: DataFrame
    mutations: DataFrame
    notices: DataFrame


def routed(records: DataFrame, profile: Profile) -> DataFrame:
    """Records with their target fields, ``route`` (ERROR_BEFORE_FILTER, FILTERED, REJECTED or VALID) and, where a row fails, ``code`` and ``field``; valid ones with ``defaulted``, the targets that got their default, where mappings have one. Write it before filtering by route: a filter that is pushed below the checks repeats each of them for every use, which with components takes very long to plan."""
    targets = [(m.target, *field_of(m)) for m in profile.mappings]
    if profile.discount:
        targets = [(t, F.coalesce(v, F.lit("")) if t == "discount" else v, e) for t, v, e in targets]
    keep = decision(list(profile.filters), records.columns)
    noted = [F.when(default_applied(m), m.target) for m in profile.mappings if m.default is not None]
    applied = [F.filter(F.array(*noted), lambda t: t.isNotNull()).alias("defaulted")] if noted else []
    rows = records.select("file", "line", "error_code", keep.alias("__keep"), *applied, *(v.alias(t) for t, v, _ in targets), *(e.alias(f"__error_{t}") for t, _, e in targets))
    checks: list[tuple[str, Column]] = [(t, F.col(f"__error_{t}")) for t, _, _ in targets]
    rows, unreadable = _amounts(rows, profile)
    checks += unreadable
    too_long = lambda t, most=LONGEST_PART: (t, length_error(text.utf16_length(F.col(t)), most))
    for t in (*IDENTITY, *profile.identity[2:-1]):
        checks += [(t, F.when(F.coalesce(F.col(t), F.lit("")) == "", "IDENTITY_COMPONENT_EMPTY"))] if t in IDENTITY else []
        checks.append(too_long(t))
    checks += [(t, F.when(fp.has_reserved(F.col(t)), "CANONICAL_CONTROL_CHARACTER")) for t in (*profile.identity, "description")]
    price = next(m for m in profile.mappings if m.target == "base_price")
    plain = text.plain_decimal(F.col("base_price"), price.decimal_sep, price.grouping_sep)
    micro = text.micro_units(plain)
    checks += [("base_price", text.price_error(F.col("base_price"), plain)), ("base_price", prices.base_price_error(micro, profile.allow_zero, profile.allow_negative))]
    rows, listed, wrong = _components(rows.withColumn("__base", micro), profile, F.col("__base"))
    checks += [*wrong, *map(too_long, profile.reference_types), too_long("description", LONGEST_DESCRIPTION)]
    code, where = None, None
    for name, error in checks:
        code = F.when(error.isNotNull(), error) if code is None else code.when(error.isNotNull(), error)
        where = F.when(error.isNotNull(), name) if where is None else where.when(error.isNotNull(), name)
    early, rejects = F.col("error_code").isNotNull(), F.col("__keep") == "REJECT"
    rows = rows.withColumn("code", F.when(early, F.col("error_code")).when(F.col("__keep") == "EXCLUDE", None).when(rejects, "FILTER_RECORD_REJECTED").otherwise(code))
    rows = rows.withColumn("field", F.when(~early & (F.col("__keep") == "KEEP"), where))
    route = F.when(early, "ERROR_BEFORE_FILTER").when(F.col("__keep") == "EXCLUDE", "FILTERED").when(F.col("code").isNotNull(), "REJECTED").otherwise("VALID")
    rows = rows.withColumn("route", route)
    if noted:
        rows = rows.withColumn("defaulted", F.when(F.col("route") == "VALID", F.col("defaulted")))
    if profile.components:
        rows = rows.withColumn("components", F.when(F.col("route") == "VALID", listed)).drop(*(f"__{what}_{c.code}" for c in profile.components for what in ("unread", "amount", "share", "wrong")), *(c.target for c in profile.components))
    return rows.withColumn("base_price", F.col("__base")).drop("__keep", "__base", "error_code", *(f"__error_{t}" for t, _, _ in targets))


def _amounts(rows: DataFrame, profile: Profile) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """Rows with the amount of each component in micro-units (null where there is none), and what is wrong with its text."""
    checks = []
    for c in profile.components:
        mapping = next(m for m in profile.mappings if m.target == c.target)
        given = text.outer_trim(F.col(c.target)) != ""
        plain = text.plain_decimal(F.col(c.target), mapping.decimal_sep, mapping.grouping_sep)
        rows = rows.withColumns({f"__unread_{c.code}": F.when(given, text.price_error(F.col(c.target), plain)), f"__amount_{c.code}": F.when(given, text.micro_units(plain))})
        checks.append((c.target, F.col(f"__unread_{c.code}")))
    return rows, checks


def _currency(rows: DataFrame, profile: Profile) -> tuple[Column, Column, Column]:
    delivered = text.normalise_reference(F.col("currency")) if "currency" in rows.columns else F.lit(None).cast("string")
    return prices.currency(delivered, profile.link_currency)


def _components(rows: DataFrame, profile: Profile, base: Column) -> tuple[DataFrame, Column, list[tuple[str, Column]]]:
    """Rows with the share of each component, their nested list, and what is wrong with them: in order of code, and at last amounts whose share can't be worked out, as the base price is 0."""
    effective, _, _ = _currency(rows, profile)
    checks, any_amount, parts = [], F.lit(False), []
    for c in sorted(profile.components, key=lambda c: c.code):
        # columns of their own, as each is used more than once: written out in place they make code too long to compile
        amount, share, wrong = (F.col(f"__{what}_{c.code}") for what in ("amount", "share", "wrong"))
        rows = rows.withColumn(f"__share_{c.code}", prices.component_share(amount, base))
        found = [prices.base_price_error(amount, c.allow_zero, c.allow_negative)]
        if c.currency is not None:
            found.append(F.when(amount.isNotNull() & (text.normalise_reference(F.col(c.currency)) != effective), "PRICE_CURRENCY_MISMATCH"))
        if c.most_percent is not None:
            found.append(F.when(~values.share_in_range(share, c.most_percent), "PRICE_PERCENTAGE_OUT_OF_RANGE"))
        found.append(F.when(share.isNotNull() & ~prices.derivation_holds(amount, base, share, profile.tolerance), "PRICE_DERIVATION_MISMATCH"))
        rows = rows.withColumn(f"__wrong_{c.code}", F.coalesce(*found))
        checks.append((c.target, wrong))
        any_amount = any_amount | amount.isNotNull()
        parts.append((c.code, amount, share))
    if parts:
        checks.append(("base_price", F.when((base == 0) & any_amount, "PRICE_PERCENTAGE_NOT_COMPUTABLE")))
    return rows, parts_of.listed(parts, effective), checks


def normalised(valid: DataFrame, profile: Profile) -> DataFrame:
    """Valid rows with row_number, currency and fingerprints, and where discount codes are parts of identities, discount_state (VALUE or EMPTY)."""
    currency, origin, printed = _currency(valid, profile)
    rows = valid.withColumnRenamed("line", "row_number").withColumn("printed", printed).withColumn("currency_origin", origin).withColumn("currency", currency)
    rows = rows.withColumn("identity_hash", fp.identity(profile.version, *map(F.col, IDENTITY), discount=F.col("discount") if profile.discount else None)).withColumn("article_fingerprint", fp.article(profile.version, F.col("description"), {c: F.col(c) for c in profile.article_fields}))
    listed = parts_of.printed(F.col("components")) if profile.components and profile.version >= 2 else None
    rows = rows.withColumn("price_fingerprint", fp.price(profile.version, fp.amount_text(F.col("base_price")), F.col("printed"), listed))
    if profile.discount:
        rows = rows.withColumn("discount_state", F.when(F.col("discount") == "", "EMPTY").otherwise("VALUE"))
    prints = ["identity_hash", "article_fingerprint", "price_fingerprint"]
    if profile.version >= 2:
        rows = rows.withColumn("reference_fingerprint", fp.references(profile.version, {t: text.normalise_reference(F.col(t)) for t in profile.reference_types}))
        prints.append("reference_fingerprint")
    return rows.withColumn("combined_fingerprint", fp.combined(*map(F.col, prints))).drop("route", "code", "field", "printed", "defaulted")


def _issue(rows: DataFrame, code: Column, of: Column, number: str = "row_number", kind: Column | None = None) -> DataFrame:
    parts = [("FIELD", of)] + ([("KIND", kind)] if kind is not None else [])
    return rows.select(code.alias("code"), of.alias("field"), signature(*parts).alias("signature"), F.col(number).alias("row_number"))


def _of_rows(written: DataFrame) -> DataFrame:
    """Issues of single records: what is wrong with them, and defaults that valid ones got."""
    found = _issue(written.where("code is not null"), F.col("code"), F.col("field"), "line")
    if "defaulted" in written.columns:
        found = found.unionByName(_issue(written.select("line", F.explode("defaulted").alias("field")), F.lit("VALUE_DEFAULT_APPLIED"), F.col("field"), "line"))
    return found


def screen(spark: SparkSession, path: str, profile: Profile, state: DataFrame, observations: DataFrame, folder: str, active_references: DataFrame | None = None, prefix: str = "1:1") -> Screened:
    """Screen the delivery at path. Routed records, staged rows and issues are written below folder, under names that tell what they were made of: the delivery's content, the profile, and for later stages the files of state, observations and references. So a call that is repeated after a crash goes on from what is there whole, an equal call writes nothing, and another profile or state has its own tables. DeliveryBlocked tells a file that can't be read."""
    warnings: list[tuple[str, str | None]] = []
    records = read_delivery(spark, path, profile.structure, expected_header=profile.expected_header, guarded=profile.guarded, warnings=warnings)
    of_file = (repr(profile), *_content(spark, path))
    of_state = (*of_file, *(sorted(t.inputFiles()) if t is not None else None for t in (state, observations, active_references)))
    written = _write(routed(records, profile), _stage(folder, "routed", of_file))
    counters = judge.counters(written)
    known = state if not profile.components or "components" in state.columns else state.withColumn("components", F.lit(None).cast(parts_of.TYPE))
    beside = delta.beside_state(_packed(normalised(written.where("route = 'VALID'"), profile)), _packed(known), [*delta.STATE_COLUMNS, "components"] if profile.components else None)
    staged = delta.change_mask(delta.classified(_unpacked(beside)), codes=[c.code for c in profile.components])
    staged = _write(staged, _stage(folder, "staged", of_state))
    # what is as it was accepted isn't judged again
    wanted = prices.values_of(staged.where("classification <> 'UNCHANGED'")).where("previous is null or previous <> amount")
    controlled = prices.control(wanted.join(_averages(observations, wanted, profile), prices.KEY, "left"), profile.deviation_percent)
    priced = F.coalesce(*(F.when(F.col("component_code") == c.code, c.target) for c in profile.components), F.lit("base_price"))
    found = _of_rows(written)
    found = found.unionByName(_issue(controlled.where("exceeded"), F.lit("PRICE_DEVIATION_EXCEEDED"), priced, kind=F.col("direction")))
    slim = staged.select(fp.packed(F.col("identity_hash")).alias("identity_hash"), "row_number", *profile.identity)
    codes = F.array(F.lit("DUPLICATE_IDENTITY_IN_DELIVERY"), F.when(F.col("collides"), "IDENTITY_HASH_COLLISION"))
    repeated = delta.repeated_rows(slim, list(profile.identity)).select("row_number", F.explode(F.array_compact(codes)).alias("code"))
    found = found.unionByName(_issue(repeated, F.col("code"), F.lit("reference")))
    if set(profile.identity) <= set(state.columns):
        found = found.unionByName(_issue(delta.collisions_with_state(staged, state, list(profile.identity)), F.lit("IDENTITY_HASH_COLLISION"), F.lit("reference")))
    held = None
    if profile.reference_types and active_references is not None:
        refs = None
        for kind in profile.reference_types:
            rows = staged.select("row_number", fp.packed(F.col("identity_hash")).alias("identity_hash"), F.lit(kind).alias("reference_type"), text.normalise_reference(F.col(kind)).alias("value"), F.coalesce("known", F.lit(False)).alias("known"))
            refs = rows if refs is None else refs.unionByName(rows)
        matched = references.found(refs, active_references.withColumn("identity_hash", fp.packed(F.col("identity_hash"))))
        # written, as issues, counters and mutations all need it
        matched = _write(matched.withColumn("identity_hash", fp.unpacked(F.col("identity_hash"))), _stage(folder, "matched", of_state))
        held = matched.where("incident or duplicate").select("row_number").distinct()
        found = found.unionByName(_issue(matched.where("incident"), F.lit("IDENTITY_REFERENCE_INCIDENT"), F.col("reference_type"), kind=F.col("match_result")))
        found = found.unionByName(_issue(matched.where("duplicate"), F.lit("DUPLICATE_REFERENCE_IN_DELIVERY"), F.col("reference_type")))
        found = found.unionByName(_issue(matched.where("link_proposal"), F.lit("REFERENCE_LINK_PROPOSED"), F.col("reference_type")))
    found = _write(catalogued(found), _stage(folder, "issues", of_state))
    tallied, sampled = issues.tally(found), issues.samples(found)
    grouped = issues.groups(tallied, sampled)
    incidents = spark.range(1).select(F.lit(None if profile.reference_types else 0).cast("bigint").alias("incidents")) if held is None else held.agg(F.count(F.lit(1)).alias("incidents"))
    judgement, bulk = _judged(counters, staged, found, grouped, state, profile, incidents)
    outcome = judgement.head()
    judgement = spark.createDataFrame([outcome], judgement.schema)  # one row, not worked out again
    bulk_price = outcome["bulk_price"]
    plan = delta.mutations(staged, outcome["creation_outcome"], prefix, held)
    plan = delta.hold_price_updates(plan, bulk_price)
    if outcome["blocked"]:
        plan = plan.limit(0)  # a blocked delivery changes nothing
    elif held is not None:
        plan = plan.unionByName(references.incident_mutations(matched, prefix), allowMissingColumns=True)
    return Screened(staged, found, grouped, counters, judgement, plan, _notices(judgement, bulk, issues.cap_notices(tallied, sampled), prices.missing_references(controlled), warnings))


def _notices(judgement: DataFrame, bulk: DataFrame, capped: DataFrame, missing: DataFrame, warnings: list[tuple[str, str | None]]) -> DataFrame:
    """Issues of the delivery as a whole, one row each."""
    said = lambda on, code, n: F.when(on, F.struct(F.lit(code).alias("code"), F.col(n).cast("bigint").alias("occurrences")))
    of_delivery = F.array(
        said(F.col("creation_outcome") == "INITIAL_LOAD", "INITIAL_LOAD_REQUIRES_APPROVAL", "candidates"), said(F.col("creation_outcome") == "THRESHOLD_EXCEEDED", "BULK_CREATION_INCIDENT", "candidates"),
        said(F.col("critical_threshold") == "EXCEEDED", "CRITICAL_RECORD_THRESHOLD_EXCEEDED", "critical_records"), said((F.col("rejected_threshold") == "EXCEEDED") & (F.col("critical_threshold") != "EXCEEDED"), "REJECTED_RECORD_THRESHOLD_EXCEEDED", "rejected_records"),
    )
    none = F.lit(None).cast("string").alias("field")
    rows = judgement.select(F.inline(F.filter(of_delivery, lambda x: x.isNotNull()))).select("code", none, F.lit("").alias("signature"), "occurrences")
    rows = rows.unionByName(bulk.select("code", none, "signature", "occurrences"))
    rows = rows.unionByName(capped.select(F.lit("ROW_ISSUE_RECORDING_CAPPED").alias("code"), none, signature(("CODE", F.col("code"))).alias("signature"), "occurrences"))
    total = F.col("no_previous") + F.col("no_avg_short") + F.col("no_avg_long")
    rows = rows.unionByName(missing.where(total > 0).select(F.lit("PRICE_REFERENCE_NOT_AVAILABLE").alias("code"), none, F.lit("").alias("signature"), total.alias("occurrences")))
    if warnings:
        told = rows.sparkSession.createDataFrame(warnings, "code string, field string")
        rows = rows.unionByName(told.select("code", "field", signature(("FIELD", F.col("field"))).alias("signature"), F.lit(1).cast("bigint").alias("occurrences")))
    return catalogued(rows)


def _averages(observations: DataFrame, wanted: DataFrame, profile: Profile) -> DataFrame:
    """From all observations, or from lists of the latest (``prices.latest_values``)."""
    if "values" not in observations.columns:
        return prices.averages(observations, wanted, profile.short, profile.long)
    return prices.averages_of(observations.join(wanted.select(*prices.KEY).distinct(), prices.KEY, "left_semi"), profile.short, profile.long)


#: What a trial read doesn't tell, as it knows no state.
NOT_EVALUATED = ("CLASSIFICATION", "PRICE_DEVIATION", "REFERENCES", "THRESHOLDS", "CREATION_POLICY")


def trial(spark: SparkSession, path: str, profile: Profile, folder: str, most: int = issues.SAMPLE_MOST) -> tuple[DataFrame, DataFrame]:
    """A trial read of a delivery: one row of counters with duplicate_rows, and the first issues of each code. It changes nothing and leaves NOT_EVALUATED open."""
    written = _write(routed(read_delivery(spark, path, profile.structure), profile), f"{folder}/trial")
    duplicates = publication.trial_duplicates(normalised(written.where("route = 'VALID'"), profile))
    found = catalogued(_of_rows(written))
    return judge.counters(written).join(duplicates, F.lit(True)), issues.samples(found, most)


def _judged(counters: DataFrame, staged: DataFrame, found: DataFrame, grouped: DataFrame, state: DataFrame, profile: Profile, incidents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bulk incidents, and one row: counters, thresholds, creation outcome, bulk incidents, blocked and verdict."""
    # rows of one each, so these joins are of one row with one row
    new = staged.agg(F.count_if(F.col("classification") == "NEW").alias("candidates"))
    size = state.agg(F.count(F.lit(1)).alias("state_size"))
    critical = issues.critical_lines(found, [*profile.critical_fields, *profile.reference_types], [m.target for m in profile.mappings])
    weight = found.agg(
        F.count_if(F.col("effect") == "BLOCK").alias("blocking"), F.count_if(F.col("effect") == "REVIEW").alias("review"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity").isin("WARNING", "ERROR")).alias("warnings"),
    )
    one = counters.join(new, F.lit(True)).join(size, F.lit(True)).join(critical, F.lit(True)).join(weight, F.lit(True)).join(incidents, F.lit(True)).withColumn("scope", F.col("raw") - F.col("filtered"))
    kind = F.when(F.col("code") == "PRICE_DEVIATION_EXCEEDED", "PRICE").when(F.col("code") == "IDENTITY_REFERENCE_INCIDENT", "IDENTITY").otherwise("GENERIC")
    bulk = publication.bulk_roll_up(issues.judged_groups(grouped.join(one.select("scope"), F.lit(True)), F.col("scope"), profile.bulk_percent).withColumn("incident_kind", kind))
    one = one.join(bulk.agg(F.count_if(F.col("code") == "BULK_PRICE_INCIDENT").alias("bulk_prices"), F.count(F.lit(1)).alias("bulk")), F.lit(True))
    percent = lambda p: F.lit(p).cast("decimal(24,12)")
    # critical lines were never staged and held rows were, so none counts twice; if either is unknown, so is the sum
    one = one.withColumn("critical_records", F.col("critical_lines") + F.col("incidents")).withColumn("rejected_records", F.col("rejected") + F.col("error_before_filter"))
    one = one.withColumn("critical_threshold", judge.threshold(F.col("critical_records"), F.col("scope"), percent(profile.critical_percent))).withColumn("rejected_threshold", judge.threshold(F.col("rejected_records"), F.col("scope"), percent(profile.rejected_percent)))
    one = one.withColumn("creation_outcome", judge.creation_outcome(F.col("candidates"), F.col("state_size"), percent(profile.creation_percent)))
    blocked = (F.col("blocking") > 0) | judge.blocking_threshold(F.col("critical_threshold"), F.col("rejected_threshold")).isNotNull()
    awaiting = F.when(F.col("creation_outcome") != "AUTOMATIC", F.col("candidates")).otherwise(0)
    one = one.withColumn("blocked", blocked).withColumn("bulk_price", F.col("bulk_prices") > 0)
    return one.withColumn("verdict", judge.verdict(F.col("blocked"), F.col("critical"), (F.col("review") > 0) | (F.col("bulk") > 0), awaiting, F.col("warnings"))), bulk


def _content(spark: SparkSession, path: str) -> tuple:
    """What tells a delivery's content, whatever its time: names and sizes of its files, and sums of hashes of its lines at their places, from one scan."""
    hashed = F.xxhash64("value", F.monotonically_increasing_id())
    sums = spark.read.text(path).select(hashed.alias("h")).agg(F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).head()
    return (*((name, size) for name, size, _ in files_at(spark, path)), *map(str, sums))


def _stage(folder: str, name: str, made_of: tuple) -> str:
    """The place of a stage's table: its name and a hash of all that it was made of."""
    return f"{folder}/{name}-{hashlib.sha256(repr(made_of).encode()).hexdigest()[:24]}"


#: Fingerprints that travel with their rows.
PRINTS = ("article_fingerprint", "price_fingerprint", "reference_fingerprint", "combined_fingerprint")


def _packed(rows: DataFrame) -> DataFrame:
    """Rows with fingerprints as bytes, for a shuffle: half as long as in hex."""
    return rows.withColumns({c: fp.packed(F.col(c)) for c in PRINTS if c in rows.columns})


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: fp.unpacked(F.col(c)) for c in (*PRINTS, *(f"old_{p}" for p in PRINTS)) if c in rows.columns})


def _write(rows: DataFrame, path: str) -> DataFrame:
    """The table at path, which is written only if it isn't there whole: a pass that ended half-way goes on behind its last table."""
    spark = rows.sparkSession
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
