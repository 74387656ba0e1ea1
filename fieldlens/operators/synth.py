"""Synthetic messages from a field catalog.

Everything random is a hash of (seed, message, place), so a message comes out the same
whatever the partitioning, and every decision is local to a row: messages meet the paths
of their schema once, and choices, repetitions and values need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from fieldlens import fixed
from fieldlens.functions import text as t
from fieldlens.operators import joins
from fieldlens.operators.patterns import draw, pattern_tokens
from fieldlens.operators.validate import xsd_regex
from fieldlens.session import checkpoint

REPEAT_SHARE = 0.3
_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def kept_paths(catalog: DataFrame, mode: str = "all") -> DataFrame:
    """Paths that can appear: in ``mandatory`` and ``yellow`` mode optional fields need to be Yellow; children need kept parents."""
    keep = F.lit(True) if mode == "all" else (F.col("min_occurs") != "0") | (F.col("field_class") == "YELLOW")
    dropped = catalog.filter(~keep).select("schema_id", F.col("path").alias("up"))
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    gone = catalog.select("schema_id", "path", F.explode(ups).alias("up")).join(dropped, ["schema_id", "up"], "left_semi").select("schema_id", "path").distinct()
    return catalog.join(gone, ["schema_id", "path"], "left_anti")


def _preferred(options: Column, parent: Column) -> Column:
    """Cd, then IBAN, then OrgId below a debtor or creditor; null leaves it to the hash."""
    has = lambda name: F.array_contains(options, name)
    party = F.lower(parent).rlike("dbtr|cdtr")
    return F.when(has("Cd"), "Cd").when(has("IBAN"), "IBAN").when(has("OrgId") & party, "OrgId")


def plan_paths(catalog: DataFrame, rules: Sequence = fixed.PICK_ONE) -> DataFrame:
    """Per path what its own and its ancestors' steps need: order, repeatability, choice groups."""
    parent = t.parent_path("path")
    rows = catalog.withColumn("parent", parent).withColumn("parent_tag", t.last_segment(parent))
    rule_of, prefer = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for name, children, _, _, preferred in reversed(tuple(rules)):
        # a rule applies when its name is part of the parent's name
        rule_of = F.when(F.col("parent_tag").contains(name), F.array(*[F.lit(c) for c in children])).otherwise(rule_of)
        prefer = F.when(F.col("parent_tag").contains(name), preferred).otherwise(prefer)
    rows = rows.withColumn("rule", rule_of).withColumn("rule_prefer", prefer)
    exclusive = F.col("rule").isNotNull() & F.array_contains("rule", F.col("tag"))
    rows = rows.withColumn("group_kind", F.when(F.coalesce("in_choice", F.lit(False)), "choice").when(exclusive, "either_or")).withColumn(
        "group_key", F.when(F.col("group_kind") == "choice", F.coalesce("choice_key", F.lit(""))).when(exclusive, F.lit("either_or")))
    groups = rows.filter(F.col("group_kind").isNotNull()).groupBy("schema_id", "parent", "group_kind", "group_key").agg(
        F.array_sort(F.collect_set("tag")).alias("options"), F.first("rule_prefer").alias("rule_prefer"))
    by_choice = _preferred(F.col("options"), F.col("parent"))
    by_rule = F.when(F.array_contains("options", F.col("rule_prefer")), F.col("rule_prefer"))
    groups = groups.withColumn("prefer", F.when(F.col("group_kind") == "choice", by_choice).otherwise(by_rule)).drop("rule_prefer")
    steps = rows.join(groups, ["schema_id", "parent", "group_kind", "group_key"], "left")
    many = (F.col("max_occurs") == "unbounded") | (F.col("max_occurs").try_cast("int") > 1)
    step = F.struct(
        F.col("tag").alias("tag"), F.col("seq").cast("int").alias("seq"), (many & F.col("rule").isNull() & F.col("group_kind").isNull()).alias("repeats"),
        F.col("options"), F.col("prefer"))
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    named = steps.select("schema_id", F.col("path").alias("up"), step.alias("step"))
    chain = (rows.select("schema_id", "path", F.posexplode(ups).alias("i", "up")).join(named, ["schema_id", "up"])
             .groupBy("schema_id", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "step"))), lambda x: x["step"]).alias("steps")))
    parents = rows.filter(~F.col("tag").startswith("@")).select("schema_id", F.col("parent").alias("path")).distinct().withColumn("has_children", F.lit(True))
    return (rows.drop("rule", "rule_prefer").join(chain, ["schema_id", "path"]).join(parents, ["schema_id", "path"], "left")
            .withColumn("has_children", F.coalesce("has_children", F.lit(False))).withColumn("kind", value_kind())
            .withColumn("tokens", pattern_tokens("pattern")).withColumn("regex", xsd_regex("pattern")))


def _uniform(*parts: Column) -> Column:
    """0 up to, not including, 1, in steps of 2^-53."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def synthesize(messages: DataFrame, catalog: DataFrame, profiles: DataFrame, mode: str = "all", seed: int = 0,
               now: datetime | None = None, repeat: float = REPEAT_SHARE) -> DataFrame:
    """Field rows of synthetic messages: (msg_id, schema_id, path, occ_path, ord, tag, value, how).

    ``messages`` is (msg_id, schema_id, profile), ``profiles`` the rows of ``read_profiles``.
    """
    # as small as the schema and read by every task: stored once
    plan = checkpoint(plan_paths(kept_paths(catalog, mode)))
    rows = joins.dim_join(messages, plan, ["schema_id"], "inner")
    seeded = rows.withColumn("seed", F.lit(seed))
    grow = f"""aggregate(steps, array(struct('' as occ, '' as ord)), (acc, s) -> flatten(transform(acc, p ->
        transform(sequence(1, if(s.repeats and pmod(xxhash64(seed, msg_id, p.occ, s.tag), 1000000) < {int(repeat * 1_000_000)}, 2, 1)), o ->
            struct(concat(p.occ, if(p.occ = '', '', '/'), s.tag, '[', o, ']') as occ, concat(p.ord, lpad(cast(s.seq as string), 8, '0'), '.', o, '/') as ord)))))"""
    placed = seeded.select("*", F.inline(F.expr(grow)))
    # a step inside a choice or an exclusive group stays only when it is the one picked there
    picked = F.expr("""forall(transform(steps, (s, i) -> struct(s as s, array_join(slice(split(occ, '/'), 1, i), '/') as place)), x -> x.s.options is null
        or x.s.tag = coalesce(x.s.prefer, x.s.options[cast(pmod(xxhash64(seed, msg_id, x.place, 'pick'), size(x.s.options)) as int)]))""")
    kept = placed.filter(picked)
    with_profile = joins.dim_join(kept, profiles.withColumnRenamed("name", "profile"), ["profile"])
    now = now or datetime.now()
    group = F.element_at("steps", -1)["options"]
    return with_profile.select(
        "msg_id", "schema_id", "path", F.regexp_replace("occ", r"(/@[^/\[]+)\[1\]$", "$1").alias("occ_path"), "ord", "tag", synth_value(now).alias("value"),
        F.when(group.isNotNull(), F.col("group_kind")).alias("picked_by"), group.alias("options"), (F.col("field_class") == "YELLOW").alias("is_yellow"),
        F.coalesce("description", F.lit("Custom profile")).alias("profile_used"))


def selections(rows: DataFrame) -> DataFrame:
    """Log of the picks of synthetic messages: where, by a choice or an exclusive rule, what was taken and out of which children."""
    return rows.filter(F.col("picked_by").isNotNull()).select(
        "msg_id", "schema_id", t.parent_path("occ_path").alias("place"), "picked_by", F.col("tag").alias("picked"), "options")


def _cases(now: datetime) -> list[tuple[str, Column, Column]]:
    """(kind, condition on the schema's columns, value): fixed, code, pattern, amount, integer, or text by name and context."""
    lit = F.lit
    tag, low, path = F.regexp_replace("tag", "^@", ""), F.lower(F.regexp_replace("tag", "^@", "")), F.lower("path")
    h = F.xxhash64("seed", "msg_id", "occ")
    u = _uniform(F.col("seed"), F.col("msg_id"), F.col("occ"), lit("u"))
    pick = lambda items: F.element_at(F.array(*[lit(x) for x in items]), (F.pmod(h, lit(len(items))) + 1).cast("int"))
    pick_array = lambda arr: F.element_at(arr, (F.pmod(h, F.size(arr)) + 1).cast("int"))
    stamp, iso, day = now.strftime("%Y%m%d%H%M%S"), now.strftime("%Y-%m-%dT%H:%M:%S"), now.strftime("%Y-%m-%d")
    hexes = F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("msg_id").cast("string"), "occ"))
    debtor, creditor = path.contains("dbtr"), path.contains("cdtr")
    text = lambda c, default: F.coalesce(F.col(c), lit(default))

    def letters(alphabet: str, n: Column) -> Column:
        one = lambda i: F.substring(lit(alphabet), F.pmod(F.xxhash64("seed", "msg_id", "occ", i), lit(len(alphabet))).cast("int") + 1, lit(1))
        return F.array_join(F.transform(F.sequence(lit(1), F.greatest(n, lit(1))), one), "")

    uuid = F.concat(F.substring(hexes, 1, 8), lit("-"), F.substring(hexes, 9, 4), lit("-4"), F.substring(hexes, 14, 3), lit("-a"), F.substring(hexes, 18, 3), lit("-"), F.substring(hexes, 21, 12))
    bic = F.when(debtor | path.contains("instg"), text("debtor_bic", "DEUTDEFF")).when(creditor | path.contains("instd"), text("creditor_bic", "BNPAFRPP")).otherwise(pick(fixed.SAMPLE_BICS))
    iban = F.when(debtor, text("debtor_iban", fixed.SAMPLE_IBANS[0])).when(creditor, text("creditor_iban", fixed.SAMPLE_IBANS[1])).otherwise(pick(fixed.SAMPLE_IBANS))
    name = (F.when(path.contains("ultmtdbtr"), F.concat(text("debtor_name", "John Smith"), lit(" (Ultimate)"))).when(debtor, text("debtor_name", "John Smith"))
            .when(path.contains("ultmtcdtr"), F.concat(text("creditor_name", "Jane Doe"), lit(" (Ultimate)"))).when(creditor, text("creditor_name", "Jane Doe")).otherwise(pick(fixed.SAMPLE_NAMES)))
    country = F.when(debtor, text("debtor_country", "DE")).when(creditor, text("creditor_country", "FR")).otherwise(pick(fixed.SAMPLE_COUNTRIES))

    places = F.coalesce(F.col("fraction_digits").try_cast("int"), lit(2))
    lo = F.greatest(F.coalesce(F.col("min_value").try_cast("double"), lit(0.01)), F.coalesce("amount_min", lit(0.01)))
    hi = F.least(F.coalesce(F.col("max_value").try_cast("double"), lit(999999999.99)), F.coalesce("amount_max", lit(999999999.99)))
    # scaled to whole units of the last digit, so rounding cannot leave the range
    scale = F.pow(lit(10.0), places)
    unit = F.ceil(lo * scale) + F.floor(u * (F.floor(hi * scale) - F.ceil(lo * scale) + 1))
    fraction = F.lpad(F.pmod(unit, scale.cast("bigint")).cast("string"), places, lit("0"))
    amount = F.when(places > 0, F.concat(F.floor(unit / scale).cast("string"), lit("."), fraction)).otherwise(unit.cast("string"))
    i_lo, i_hi = F.coalesce(F.col("min_value").try_cast("bigint"), lit(0)), F.coalesce(F.col("max_value").try_cast("bigint"), lit(999999))
    integer = (i_lo + F.floor(u * (i_hi - i_lo + 1))).cast("string")

    party = lambda s: F.when(debtor, F.col(f"debtor_{s}")).when(creditor, F.col(f"creditor_{s}"))
    address = (F.when(low == "strtnm", F.coalesce(party("street"), lit("Main Street 123"))).when(low == "pstcd", F.coalesce(party("postal_code"), lit("10115")))
               .when(low == "twnnm", F.coalesce(party("city"), lit("Berlin")))
               .when(low == "adrline", F.concat_ws(" ", F.coalesce(party("street"), lit("Main St")), F.coalesce(party("city"), lit("City")))).otherwise("Address Line"))
    six = F.upper(F.substring(hexes, 1, 6))
    ident = (F.when(low == "msgid", F.concat(lit("MSG" + stamp), six)).when(low == "uetr", uuid).when(low == "endtoendid", F.concat(lit("E2E" + stamp), six))
             .when(low == "txid", F.concat(lit("TX" + stamp), six)).otherwise(F.concat(tag, F.substring(hexes, 1, 12))))
    text_cases = [
        ("bic", low.contains("bic"), bic), ("iban", low.contains("iban"), iban),
        ("lei", low == "lei", F.concat(letters(_UPPER + _DIGITS, lit(18)), lit("00"))), ("name", (low == "nm") | low.contains("name"), name),
        ("country", low.isin("ctry", "ctryofbirth", "ctryofres"), country), ("currency", low.contains("ccy"), text("currency", "EUR")),
        ("one", low == "nboftxs", lit("1")), ("sum", low == "ctrlsum", amount), ("datetime", low.contains("dttm") | low.contains("datetime"), lit(iso + ".000Z")),
        ("date", low.contains("dt") | low.contains("date"), lit(day)), ("amount_text", low.contains("amt"), amount),
        ("id", low.isin("id", "msgid", "instrid", "endtoendid", "txid", "uetr", "clrtxid"), ident),
        ("address", low.isin("strtnm", "bldgnb", "pstcd", "twnnm", "adrline", "pstladr"), address), ("bearer", low == "chrgbr", text("charge_bearer", "SLEV")),
        ("settlement", low == "sttlmmtd", lit("CLRG")), ("purpose", (low == "cd") & path.contains("purp"), lit("SALA")), ("cd", low == "cd", lit("TEST")),
        ("prtry", low == "prtry", lit("PROPRIETARY")), ("issuer", low == "issr", lit("ISSUER")),
        ("number", low.contains("nb"), (lit(1) + F.floor(u * 100)).cast("bigint").cast("string")), ("remittance", low == "ustrd", lit("Payment for invoice 12345")),
        ("ref", low == "ref", F.concat(lit("REF" + day.replace("-", "")), (lit(1000) + F.floor(u * 9000)).cast("bigint").cast("string"))),
        ("text", lit(True), F.left(F.concat(lit("Test"), tag), lit(35))),
    ]

    pattern = t.blank("pattern")
    # a value known by its name where the pattern takes it, otherwise one drawn from the pattern's tokens
    named = (F.when(low.contains("bic"), bic).when(low.contains("iban"), iban).when(low == "uetr", uuid).when(low.contains("ctry"), country)
             .when(low.contains("ccy"), text("currency", "EUR")).when(low.contains("dttm"), lit(iso)).when(low.contains("dt"), lit(day)))
    drawn = draw("tokens", "seed, msg_id, occ", "try_cast(min_length as int)", "try_cast(max_length as int)")
    matching = F.when(F.coalesce(F.rlike(named, F.col("regex")), lit(False)), named).otherwise(F.coalesce(drawn, F.concat(lit("TEST"), letters(_DIGITS, lit(6)))))
    allowed = lambda c: F.array_contains("enums", F.col(c))
    code = (F.when(path.contains("svclvl") & low.contains("cd") & allowed("service_level"), F.col("service_level"))
            .when(path.contains("lclinstrm") & low.contains("cd") & allowed("local_instrument"), F.col("local_instrument"))
            .when(path.contains("chrgbr") & allowed("charge_bearer"), F.col("charge_bearer")).otherwise(pick_array(F.col("enums"))))
    base = F.lower(t.blank("type"))
    attribute = F.col("tag").startswith("@")
    fit = lambda c: t.pad_or_cut(c, F.coalesce(F.col("min_length").try_cast("int"), lit(1)), F.coalesce(F.col("max_length").try_cast("int"), lit(100)))
    return [
        ("fixed", t.blank("fixed") != "", F.col("fixed")), ("code", F.size("enums") > 0, code), ("attribute_currency", attribute & low.contains("ccy"), text("currency", "EUR")),
        ("attribute", attribute, lit("AttrValue")), ("pattern", pattern != "", matching),
        ("amount", base.contains("decimal") | low.contains("amt") | base.contains("amount"), amount), ("integer", base.isin("integer", "int", "long", "short"), integer),
        *[(n, c, fit(v)) for n, c, v in text_cases],
    ]


def value_kind() -> Column:
    """Which rule fills a field; depends on the schema alone, so it is settled once per path."""
    out = F.lit("text")
    for name, when, _ in reversed(_cases(datetime(2000, 1, 1))):
        out = F.when(when, name).otherwise(out)
    return F.when(F.col("has_children") & ~F.col("tag").startswith("@"), F.lit("container")).otherwise(out)


def synth_value(now: datetime) -> Column:
    """Value of a field of a known kind; containers have none."""
    out = F.lit(None).cast("string")
    for name, _, value in reversed(_cases(now)):
        out = F.when(F.col("kind") == name, value).otherwise(out)
    return out


def synthesis_report(rows: DataFrame, by: Sequence[str] = ("schema_id",), issues: DataFrame | None = None) -> DataFrame:
    """Messages, fields, choices made, exclusive rules applied and Yellow fields; with ``issues`` (one row each, ``msg_id``) the validation errors.

    ``by`` may name ``profile_used``. Everything is summed per message first, so issues meet messages, not fields.
    """
    own = rows.groupBy(*by, "msg_id").agg(
        F.count("*").alias("fields"), F.count_if(F.col("picked_by") == "choice").alias("choices"),
        F.count_if(F.col("picked_by") == "either_or").alias("rules_applied"), F.count_if("is_yellow").alias("yellow_fields"))
    sums = ["fields", "choices", "rules_applied", "yellow_fields"]
    if issues is not None:
        own = own.join(issues.groupBy("msg_id").agg(F.count("*").alias("validation_errors")), "msg_id", "left").fillna(0, ["validation_errors"])
        sums.append("validation_errors")
    return own.groupBy(*by).agg(F.count_distinct("msg_id").alias("messages"), *[F.sum(c).alias(c) for c in sums])


def synthetic_messages(rows: DataFrame) -> DataFrame:
    """Synthetic rows as XML text per message."""
    from fieldlens.operators.flatten import rebuild_xml

    # parents are written by their children; a childless element keeps its empty tag
    leaves = rows.filter(F.col("value").isNotNull() | F.col("tag").startswith("@"))
    return rebuild_xml(leaves, "msg_id", order="ord", path="occ_path")
