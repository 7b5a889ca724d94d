"""Secret scans with a ledger of blobs.

Every version of every document is addressed by the SHA-256 of its text. The ledger says which (blob, rule, rule version)
were scanned; only pairs it lacks are scanned, once for all copies, and findings are joined back to all paths that hold the
blob. A rule's cheap condition is tested where the text lies, so only texts that can hold a finding are ever shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import OWN, columns_of, materialize


@dataclass(frozen=True)
class Rule:
    """pattern finds secrets; no text without a match of hint has one. Both mean the same to Java's engine and to RE2."""

    id: str
    version: int
    hint: str
    pattern: str

    @property
    def name(self) -> str:
        return f"{self.id}@{self.version}"


_ASSIGNED = r"(?i)(?:token|secret|password|passwd|api_?key|access_?key)[\"']?[ ]{0,3}[:=]{1,2}[ ]{0,3}[\"']"

#: Values have no upper bound: a longer one is found, and redacted, as a whole. A version goes up whenever a pattern changes.
RULES: tuple[Rule, ...] = (
    Rule("assigned-secret", 2, _ASSIGNED, _ASSIGNED + r"[0-9A-Za-z_+/=.-]{16,}[\"']"),
    Rule("aws-access-key", 1, "A[KS]IA", "(?:AKIA|ASIA)[0-9A-Z]{16}"),
    Rule("azure-storage-key", 1, "AccountKey=", "AccountKey=[0-9A-Za-z+/]{86}=="),
    Rule("age-secret-key", 1, "AGE-SECRET-KEY-1", "AGE-SECRET-KEY-1[0-9A-Z]{58}"),
    Rule("basic-authorization", 1, "uthorization: Basic ", "[Aa]uthorization: Basic [0-9A-Za-z+/]{16,}={0,2}"),
    Rule("bearer-authorization", 1, "uthorization: Bearer ", "[Aa]uthorization: Bearer [0-9A-Za-z._~+/-]{20,}={0,2}"),
    Rule("credentials-in-url", 1, "://", "://[0-9A-Za-z_.%+-]+:[0-9A-Za-z_.%+!$&*-]{3,}@[0-9A-Za-z.-]+"),
    Rule("databricks-token", 1, "dapi", "dapi[0-9a-f]{32}"),
    Rule("digitalocean-token", 1, "_v1_", "do[opr]_v1_[0-9a-f]{64}"),
    Rule("discord-webhook", 1, "/api/webhooks/", "discord(?:app)?[.]com/api/webhooks/[0-9]{17,}/[0-9A-Za-z_-]{60,}"),
    Rule("doppler-token", 1, "dp.pt.", "dp[.]pt[.][0-9A-Za-z]{43}"),
    Rule("github-token", 2, "gh[pousr]_", "gh[pousr]_[0-9A-Za-z]{36,}"),
    Rule("github-fine-grained-token", 1, "github_pat_", "github_pat_[0-9A-Za-z_]{22,}"),
    Rule("gitlab-token", 1, "glpat-", "glpat-[0-9A-Za-z_-]{20,}"),
    Rule("google-api-key", 1, "AIza", "AIza[0-9A-Za-z_-]{35}"),
    Rule("google-client-secret", 1, "GOCSPX-", "GOCSPX-[0-9A-Za-z_-]{28}"),
    Rule("google-oauth-token", 1, "ya29.", "ya29[.][0-9A-Za-z_-]{20,}"),
    Rule("grafana-token", 1, "glsa_", "glsa_[0-9A-Za-z]{32}_[0-9a-f]{8}"),
    Rule("huggingface-token", 1, "hf_", "hf_[0-9A-Za-z]{34,}"),
    Rule("json-web-token", 1, "eyJ", r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    Rule("linear-key", 1, "lin_api_", "lin_api_[0-9A-Za-z]{40}"),
    Rule("mailchimp-key", 1, "-us", "[0-9a-f]{32}-us[0-9]{1,2}"),
    Rule("mailgun-key", 1, "key-", "key-[0-9a-z]{32}"),
    Rule("new-relic-key", 1, "NRAK-", "NRAK-[0-9A-Z]{27}"),
    Rule("npm-token", 1, "npm_", "npm_[0-9A-Za-z]{36,}"),
    Rule("postman-key", 1, "PMAK-", "PMAK-[0-9a-f]{24}-[0-9a-f]{34}"),
    Rule("private-key", 1, "-----BEGIN ", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[0-9A-Za-z+/= \t\r\n]{16,}-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("pypi-token", 1, "pypi-AgEI", "pypi-AgEI[0-9A-Za-z_-]{50,}"),
    Rule("sendgrid-key", 1, "SG.", "SG[.][0-9A-Za-z_-]{22}[.][0-9A-Za-z_-]{43}"),
    Rule("shopify-token", 1, "shp", "shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}"),
    Rule("slack-token", 2, "xox[abprs]-", "xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("slack-webhook", 1, "hooks.slack.com/", "hooks[.]slack[.]com/services/T[0-9A-Z]+/B[0-9A-Z]+/[0-9A-Za-z]+"),
    Rule("square-token", 1, "sq0", "sq0(?:atp-[0-9A-Za-z_-]{22}|csp-[0-9A-Za-z_-]{43})"),
    Rule("stripe-key", 2, "[rs]k_live_", "[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("telegram-bot-token", 1, ":AA", "[0-9]{8,10}:AA[0-9A-Za-z_-]{33}"),
    Rule("terraform-token", 1, ".atlasv1.", "[0-9A-Za-z]{14}[.]atlasv1[.][0-9A-Za-z_-]{60,}"),
    Rule("twilio-key", 1, "SK", "SK[0-9a-f]{32}"),
    Rule("vault-token", 1, "hvs.", "hvs[.][0-9A-Za-z_-]{24,}"),
)

LEDGER = "blob string, rule_id string, rule_version int"


@dataclass
class Scan:
    """findings: (blob, rule_id, rule_version, nth, secret_sha256, secret_length), the new ones only. everything: with those that were
    known. paths: all findings at all paths. ledger: what it holds after this scan, to be kept for the next."""

    findings: DataFrame
    paths: DataFrame
    ledger: DataFrame
    everything: DataFrame


def _hinted(text: Column, rule: Rule) -> Column:
    return text.contains(rule.hint) if not any(c in rule.hint for c in "[(?") else text.rlike(rule.hint)


def _blob(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _ledger_lacks(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs with own todo: the names of the rules that the ledger lacks; none without any."""
    wanted = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        return blobs.withColumn(OWN + "todo", wanted)
    names = F.concat_ws("@", F.col("rule_id"), F.col("rule_version").cast("string"))
    seen = ledger.groupBy(F.col("blob").alias(OWN + "blob")).agg(F.collect_set(names).alias(OWN + "seen"))
    joined = blobs.join(seen, F.col("blob") == F.col(OWN + "blob"), "left")
    todo = F.array_except(wanted, F.coalesce(F.col(OWN + "seen"), F.array().cast("array<string>")))
    return joined.withColumn(OWN + "todo", todo).drop(OWN + "blob", OWN + "seen").where(F.size(OWN + "todo") > 0)


def scan(docs: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, path: tuple[str, ...] = ("doc_id", "source"), rules: tuple[Rule, ...] = RULES) -> Scan:
    """Scans what the ledger lacks. docs has text and the path columns; no other column is read.

    known: findings of earlier scans (as in Scan.findings), which are joined to the present paths too; those of rules or
    versions that are not in rules are left out. A row with a null text has no blob, hence neither finding nor ledger entry.
    An empty text is a blob without findings. Whole texts are scanned. nth counts a rule's matches in a blob from 1, left to
    right. Repeated rows are paths of their own, each with its findings; null paths too. An empty table gives empty results.
    """
    text = F.col("text")
    held = docs.where(text.isNotNull())
    able = F.array_compact(F.array(*[F.when(_hinted(text, r), F.lit(r.name)) for r in rules]))
    hinted = held.select(able.alias(OWN + "able"), "text").where(F.size(OWN + "able") > 0)
    hinted = hinted.select(_blob(text).alias("blob"), OWN + "able", "text")
    todo = _ledger_lacks(hinted, ledger, rules)
    todo = todo.withColumn(OWN + "able", F.array_intersect(OWN + "able", OWN + "todo")).where(F.size(OWN + "able") > 0)
    once = todo.groupBy("blob").agg(F.first("text").alias("text"), F.first(OWN + "able").alias(OWN + "able"))
    matches = F.array(*[
        F.struct(F.lit(r.id).alias("id"), F.lit(r.version).alias("version"), F.when(F.array_contains(OWN + "able", r.name), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias("m"))
        for r in rules
    ])
    by_rule = once.select("blob", F.explode(matches).alias("r")).select("blob", "r.*")
    found = by_rule.select("blob", F.col("id").alias("rule_id"), F.col("version").alias("rule_version"), F.posexplode("m").alias(OWN + "i", OWN + "secret"))
    findings = found.select(
        "blob", "rule_id", "rule_version", (F.col(OWN + "i") + 1).alias("nth"),
        F.sha2(F.col(OWN + "secret").cast("binary"), 256).alias("secret_sha256"), F.length(OWN + "secret").alias("secret_length"),
    )

    everything = findings
    if known is not None:
        current = F.array(*[F.lit(r.name) for r in rules])
        names = F.concat_ws("@", F.col("rule_id"), F.col("rule_version").cast("string"))
        everything = findings.unionByName(known.where(F.array_contains(current, names)).select(*findings.columns))
    paths = held.select(*[F.col(c).alias(OWN + c) for c in path], _blob(text).alias("blob"))
    at = paths.join(everything, "blob").select(*[F.col(OWN + c).alias(c) for c in path], *everything.columns)

    blobs = held.select(_blob(text).alias("blob")).distinct()
    new = _ledger_lacks(blobs, ledger, rules).select("blob", F.explode(OWN + "todo").alias("n"))
    new = new.select("blob", F.substring_index("n", "@", 1).alias("rule_id"), F.substring_index("n", "@", -1).cast("int").alias("rule_version"))
    return Scan(findings, at, new if ledger is None else ledger.select("blob", "rule_id", "rule_version").unionByName(new), everything)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """docs with each secret that scan() finds replaced by its rule's name in brackets, rule after rule, and n_chars (where docs has it)
    set to the new length. A blob is scanned and rewritten once, by the rules that have findings in it, and the result goes to all rows that hold it;
    what the ledger names isn't scanned again and is redacted by the known findings. Rows without a secret are left alone, null and empty texts
    too. Where matches of two rules overlap, the rule that comes first in rules names it. Whole texts are redacted; repeated rows each; an empty
    table gives an empty one; other columns may have any name."""
    text = F.col("text")
    some = F.lit(False)
    for r in rules:
        some = some | _hinted(text, r)
    some = F.coalesce(some, F.lit(False))
    # Only rows with some hint can hold a secret; the others are neither addressed nor shuffled.
    hinted = materialize(docs.where(some).withColumn(OWN + "blob", _blob(text)), "hinted")
    texts = hinted.groupBy(OWN + "blob").agg(F.first("text").alias("text"))
    found = scan(texts, ledger, known, (), rules).everything
    names = F.concat_ws("@", F.col("rule_id"), F.col("rule_version").cast("string"))
    found = found.groupBy(F.col("blob").alias(OWN + "blob")).agg(F.collect_set(names).alias(OWN + "rules"))
    clean = text
    for r in rules:
        pattern = F.when(F.array_contains(OWN + "rules", r.name), F.lit(r.pattern)).otherwise(F.lit("(?!)"))  # matches nothing
        clean = F.regexp_replace(clean, pattern, F.lit(f"[{r.id}]"))
    once = texts.join(found, OWN + "blob").select(OWN + "blob", clean.alias(OWN + "text"))
    out = hinted.join(once, OWN + "blob", "left").withColumn(OWN + "text", F.coalesce(OWN + "text", "text"))
    if "n_chars" in docs.columns:
        changed = F.col("text") != F.col(OWN + "text")
        out = out.withColumn("n_chars", F.when(changed, F.length(OWN + "text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    out = out.withColumn("text", F.col(OWN + "text")).select(*columns_of(docs))
    return docs.where(~some).select(*columns_of(docs)).union(out)


def oracle_sql(table: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for scan(documents).paths."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT doc_id, source, text, {quoted(r.id)} AS rule_id, {r.version} AS rule_version, regexp_extract_all(text, {quoted(r.pattern)}) AS m FROM {table} t WHERE text IS NOT NULL" for r in rules
    )
    return f"""SELECT doc_id, source, sha256(text) AS blob, rule_id, CAST(rule_version AS INTEGER) AS rule_version, CAST(nth AS INTEGER) AS nth,
        sha256(m[nth]) AS secret_sha256, CAST(length(m[nth]) AS INTEGER) AS secret_length
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS nth FROM ({each}))"""
