"""A prioritised rule table compiled to one projection.

A condition is ``feature, direction, threshold`` (limits inclusive, missing values and NaN count as 0).
A rule fires if any primary and all secondary conditions hold; the first rule by tier and
order is the assignment.  Rule tables are data: pass a list, or read one with ``read_rules``.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.common import all_of, any_of, clean

#: What a row without any fired rule gets.
NONE, NONE_TEXT = "UNCERTAIN_SIGNIFICANCE", "No NT signal above noise floor"


@dataclass(frozen=True)
class Condition:
    feature: str
    direction: str  # negative, positive or any
    threshold: float

    def holds(self, columns: list[str]) -> Column:
        x = self.value(columns)
        if self.direction == "negative":
            return x <= self.threshold
        if self.direction == "positive":
            return x >= self.threshold
        return F.abs(x) >= abs(self.threshold)

    def value(self, columns: list[str]) -> Column:
        return F.coalesce(clean(F.col(f"`{self.feature}`").cast("double")), F.lit(0.0)) if self.feature in columns else F.lit(0.0)

    def text(self, columns: list[str]) -> Column:
        sign = {"negative": "<=", "positive": ">=", "any": " abs>="}[self.direction]
        return F.format_string(f"{self.feature.removeprefix('D_BED_')}{sign}{self.threshold:.2f} [obs %.3f]", self.value(columns))


@dataclass(frozen=True)
class Rule:
    name: str
    tier: int
    primary: tuple[Condition, ...]
    secondary: tuple[Condition, ...] = ()
    description: str = ""
    order: int = 0

    def fires(self, columns: list[str]) -> Column:
        return any_of([c.holds(columns) for c in self.primary]) & all_of([c.holds(columns) for c in self.secondary])


def read_rules(path: str, variant_type: str) -> list[Rule]:
    """Rules of a CSV table with ``variant_type, mechanism, tier, order_within_tier, condition_role, feature, direction, threshold, description``."""
    found: dict[str, dict] = {}
    with open(path, newline="") as f:
        for r in csv.DictReader(f):
            if r["variant_type"] == variant_type:
                x = found.setdefault(r["mechanism"], {"tier": int(r["tier"]), "order": int(r["order_within_tier"]), "description": r["description"], "primary": [], "secondary": []})
                x["primary" if r["condition_role"].startswith("primary") else "secondary"].append(Condition(r["feature"], r["direction"], float(r["threshold"])))
    rules = [Rule(n, x["tier"], tuple(x["primary"]), tuple(x["secondary"]), x["description"], x["order"]) for n, x in found.items()]
    return sorted(rules, key=lambda r: (r.tier, r.order))


def rule_table(rules: list[Rule]) -> list[dict]:
    """One entry for each condition, with whether its rule can ever be assigned and what pre-empts it."""
    earlier = pre_empted(rules)
    out = []
    for r in sorted(rules, key=lambda r: (r.tier, r.order)):
        for role, conditions in (("primary (OR)", r.primary), ("secondary (AND)", r.secondary)):
            for c in conditions:
                out.append({"mechanism": r.name, "tier": r.tier, "order_within_tier": r.order, "condition_role": role, "feature": c.feature, "direction": c.direction, "threshold": c.threshold, "description": r.description, "can_be_assigned": r.name not in earlier, "pre_empted_by": earlier.get(r.name, "")})
    return out


def _implies(a: Condition, b: Condition) -> bool:
    """Whenever ``a`` holds, ``b`` does."""
    if a.feature != b.feature:
        return False
    if a.direction == b.direction == "negative":
        return a.threshold <= b.threshold
    if a.direction == b.direction == "positive":
        return a.threshold >= b.threshold
    if b.direction == "any":
        return (a.direction == "any" and abs(a.threshold) >= abs(b.threshold)) or (a.direction == "negative" and a.threshold <= -abs(b.threshold)) or (a.direction == "positive" and a.threshold >= abs(b.threshold))
    return False


def pre_empted(rules: list[Rule]) -> dict[str, str]:
    """Rules that can never be first, with the earlier rule that fires whenever they do."""
    ordered = sorted(rules, key=lambda r: (r.tier, r.order))
    out = {}
    for i, r in enumerate(ordered):
        for e in ordered[:i]:
            covered = all(any(_implies(x, y) for y in e.primary for x in (p, *r.secondary)) for p in r.primary)
            if covered and all(any(all(_implies(x, y) for x in [p]) or any(_implies(s, y) for s in r.secondary) for p in r.primary) for y in e.secondary):
                out[r.name] = e.name
                break
    return out


def assign(df: DataFrame, rules: list[Rule], prefix: str = "NT") -> DataFrame:
    """Adds mechanism, description, trigger, all fired rules, their number, tier (-1: none), rule text and whether any input was there."""
    columns, ordered = df.columns, sorted(rules, key=lambda r: (r.tier, r.order))
    fired = [F.col(f"__r{i}") for i in range(len(ordered))]
    out = df.select("*", *[r.fires(columns).alias(f"__r{i}") for i, r in enumerate(ordered)])

    def first(of, default):
        return reduce(lambda rest, i: F.when(fired[i], of(ordered[i])).otherwise(rest), reversed(range(len(ordered))), default)

    def trigger(r: Rule) -> Column:
        return F.coalesce(*[F.when(c.holds(columns), F.format_string(f"{c.feature.removeprefix('D_BED_')}=%.3f", c.value(columns))) for c in r.primary])

    def text(r: Rule) -> Column:
        ors = F.array_join(F.array_compact(F.array(*[F.when(c.holds(columns), c.text(columns)) for c in r.primary])), " OR ")
        return F.concat_ws(" AND ", ors, *[c.text(columns) for c in r.secondary])

    features = sorted({c.feature for r in rules for c in (*r.primary, *r.secondary)} & set(columns))
    every = F.array_compact(F.array(*[F.when(f, F.lit(f"{r.name}(P{r.tier})")) for f, r in zip(fired, ordered, strict=True)]))
    return out.select(
        *df.columns,
        first(lambda r: F.lit(r.name), F.lit(NONE)).alias(f"{prefix}_Mechanism"),
        first(lambda r: F.lit(r.description), F.lit(NONE_TEXT)).alias(f"{prefix}_Description"),
        first(trigger, F.lit("")).alias(f"{prefix}_Trigger"),
        F.array_join(every, "; ").alias(f"{prefix}_All_Mechanisms"),
        F.size(every).alias(f"{prefix}_Mechanism_Count"),
        first(lambda r: F.lit(r.tier), F.lit(-1)).alias(f"{prefix}_Tier"),
        first(text, F.lit("")).alias(f"{prefix}_Rule"),
        any_of([clean(F.col(f"`{f}`").cast("double")).isNotNull() for f in features]).alias(f"{prefix}_Scored"),
    )


def assign_by_confidence(df: DataFrame, rules: list[Rule], confidence: dict[str, Column]) -> DataFrame:
    """Older form: of the fired rules of the least tier the one with the highest confidence (then name) wins; all by tier."""
    columns = df.columns
    fired = F.array_compact(F.array(*[F.when(r.fires(columns), F.struct(F.lit(r.tier).alias("tier"), (-confidence[r.name]).alias("c"), F.lit(r.name).alias("name"))) for r in rules]))
    out = df.withColumn("__f", F.array_sort(fired))
    best = F.get("__f", F.lit(0))
    return out.select(*columns, F.coalesce(best["name"], F.lit(NONE)).alias("mechanism"), (-best["c"]).alias("confidence"), F.transform("__f", lambda s: F.concat(F.lit("T"), s["tier"].cast("string"), F.lit(":"), s["name"])).alias("by_tier")).drop("__f")


def merged_rule_table(tables: dict[str, list[Rule]], spark) -> DataFrame:
    """Conditions of several rule sets side by side; ``variant_type`` is ``Both`` where two sets share one."""
    rows = [(vt, x["mechanism"], x["tier"], x["condition_role"], x["feature"], x["direction"], float(x["threshold"])) for vt, rules in tables.items() for x in rule_table(rules)]
    df = spark.createDataFrame(rows, "variant_type string, mechanism string, tier int, role string, feature string, direction string, threshold double")
    keys = ["mechanism", "tier", "role", "feature", "direction", "threshold"]
    return df.groupBy(*keys).agg(F.when(F.count_distinct("variant_type") > 1, F.lit("Both")).otherwise(F.min("variant_type")).alias("variant_type"))


def feature_usage(rules: list[Rule]) -> dict[str, list[str]]:
    """Features and the rules that ask for them."""
    out: dict[str, list[str]] = {}
    for r in rules:
        for c in (*r.primary, *r.secondary):
            if r.name not in out.setdefault(c.feature, []):
                out[c.feature].append(r.name)
    return out


def ladder(value: Column, steps: list[tuple[float, str]], default: str) -> Column:
    """The label of the first step whose limit the value reaches."""
    return reduce(lambda rest, s: F.when(value >= s[0], s[1]).otherwise(rest), reversed(steps), F.lit(default))


def parse_rules(text: str, prefix: str = "D_BED_") -> list[Rule]:
    """Rules of lines ``tier.order NAME: primary or primary and secondary; description``.

    A condition is ``feature sign threshold`` with the sign ``<=``, ``>=`` or ``|>=`` (magnitude);
    features have ``prefix`` before them unless they begin with ``@``.
    """
    direction = {"<=": "negative", ">=": "positive", "|>=": "any"}

    def condition(part: str) -> Condition:
        feature, sign, threshold = part.split()
        return Condition(feature[1:] if feature.startswith("@") else prefix + feature, direction[sign], float(threshold))

    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        head, _, rest = line.partition(": ")
        place, name = head.split()
        conditions, _, description = rest.partition("; ")
        first, *others = conditions.split(" and ")
        tier, order = map(int, place.split("."))
        out.append(Rule(name, tier, tuple(condition(x) for x in first.split(" or ")), tuple(condition(x) for x in others), description, order))
    return out


#: The published rules that both kinds of variants share, and those of each kind.
SHARED_RULES = """
0.0 SPLICE_SITE_DESTROYED: splice_donor <= -0.2 or splice_acceptor <= -0.2; Loss of canonical splice donor or acceptor site
0.1 START_LOSS: start_codon <= -0.15; Loss of translation initiation codon
0.2 STOP_CODON_DISRUPTION: stop_codon <= -0.2; Disruption of stop codon causing read-through
1.0 CRYPTIC_SPLICE_GAIN: splice_donor >= 0.2 or splice_acceptor >= 0.2; Creation of new cryptic splice site
1.1 SPLICE_INDUCED_EXONIZATION: exon >= 0.15 and intron <= -0.1; Intronic sequence included as coding exon via splice disruption
1.2 SPLICE_INDUCED_INTRON_RETENTION: intron >= 0.2 and splice_donor <= -0.1; Intron retention due to splice site weakening
1.3 EXON_SKIPPING_INDUCED: skipped_exon >= 0.15 and always_on_exon <= -0.1; Induction of exon skipping
1.4 CONSTITUTIVE_EXON_LOSS: always_on_exon <= -0.2; Loss of constitutively included exon
1.5 EXON_LOSS: exon <= -0.2; Loss of exon identity
1.6 CODING_LOSS: exon <= -0.15 and ORF <= -0.1; Loss of coding exon identity with ORF disruption
1.7 ORF_DISRUPTION: ORF <= -0.2; Disruption of open reading frame
1.8 CRYPTIC_EXON_INCLUSION: skipped_exon >= 0.2 and exon >= 0.1; Inclusion of cryptic/normally-skipped exon into transcript
2.0 START_LOSS_WITH_UTR_EXTENSION: start_codon <= -0.1 and 5UTR+ >= 0.1; Start codon loss with consequent 5'UTR extension
2.1 START_LOSS_WITH_ORF_DISRUPTION: start_codon <= -0.1 and ORF <= -0.1; Start codon loss with downstream ORF disruption
2.2 PROMOTER_DESTRUCTION: promoter_Tissue_specific <= -0.2 or promoter_Tissue_invariant <= -0.2; Destruction of promoter element
2.3 ENHANCER_DESTRUCTION: enhancer_Tissue_specific <= -0.2 or enhancer_Tissue_invariant <= -0.2; Destruction of enhancer element
2.4 REGULATORY_GAIN: enhancer_Tissue_specific >= 0.2 or promoter_Tissue_specific >= 0.2 or enhancer_Tissue_invariant >= 0.2 or promoter_Tissue_invariant >= 0.2; Gain of regulatory element (potential ectopic expression)
2.5 UTR5_DISRUPTION: 5UTR+ <= -0.15 or 5UTR- >= 0.15; Disruption of 5' UTR structure or regulation
2.6 UTR3_DISRUPTION: 3UTR+ <= -0.15 or 3UTR- >= 0.15; Disruption of 3' UTR structure or regulation
2.7 POLYA_SIGNAL_LOSS: polyA_signal <= -0.15; Loss of polyadenylation signal
2.8 CTCF_BOUNDARY_DISRUPTION: CTCF-bound <= -0.15; Disruption of CTCF binding / chromatin boundary element
3.0 CRYPTIC_ORF_GAIN: ORF >= 0.2; Creation of cryptic open reading frame
3.1 CRYPTIC_ORF_GAIN_WITH_INTRON_LOSS: ORF >= 0.15 and intron <= -0.1; ORF gain with intron loss — likely splice-induced exonization
3.2 ABERRANT_EXON_INCLUSION: always_on_exon >= 0.2 and intron <= -0.1; Aberrant inclusion of intronic sequence as constitutive exon
3.3 INTRON_RETENTION: intron >= 0.2 and exon <= -0.1; Retention of intron in mature transcript
3.4 RECIPROCAL_EXON_GAIN_INTRON_LOSS: exon >= 0.15 and intron <= -0.15; Exon gain with reciprocal intron loss (exonization)
3.5 RECIPROCAL_EXON_LOSS_INTRON_GAIN: exon <= -0.15 and intron >= 0.15; Exon loss with reciprocal intron gain (intronization)
3.6 GENE_ARCHITECTURE_DISRUPTION: protein_coding_gene <= -0.2; Disruption of overall gene architecture
3.7 LNCRNA_DISRUPTION: lncRNA <= -0.2; Disruption of lncRNA
4.0 SPLICE_CHANGE: splice_donor |>= 0.08 or splice_acceptor |>= 0.08; Detectable change in splice site signal
4.1 REGULATORY_CHANGE: enhancer_Tissue_specific |>= 0.08 or promoter_Tissue_specific |>= 0.08 or enhancer_Tissue_invariant |>= 0.08 or promoter_Tissue_invariant |>= 0.08; Detectable change in regulatory element
4.2 EXON_CHANGE: exon |>= 0.08 or always_on_exon |>= 0.08 or skipped_exon |>= 0.08; Detectable change in exon identity
4.3 ORF_CHANGE: ORF |>= 0.08; Detectable change in ORF
4.4 INTRON_CHANGE: intron |>= 0.08; Detectable change in intron signal
4.5 UTR_CHANGE: 5UTR+ |>= 0.08 or 5UTR- |>= 0.08 or 3UTR+ |>= 0.08 or 3UTR- |>= 0.08; Detectable change in UTR signal
4.6 GENE_CHANGE: protein_coding_gene |>= 0.08 or lncRNA |>= 0.08; Detectable change in gene-level signal
"""
SNP_RULES = """
5.0 SEQUENCE_CONSTRAINED: @LLR <= -1.0 and @MLM_Prior >= 0.3; Position under sequence constraint — MLM confident in REF and strongly prefers it over ALT
"""
INDEL_RULES = """
5.0 SEQUENCE_CONSTRAINED: @MLM_logprob_delta <= -1.0 or @MLM_KL_max >= 2.0; Sequence under constraint — MLM probability or distributional disruption detected
5.1 EMBEDDING_DISRUPTED: @EMB_cosine_dist >= 0.15; Embedding-space disruption — MLM internal representation substantially altered by variant
"""


def published_rules(variant_type: str) -> list[Rule]:
    """The 37 rules of ``snp`` or the 38 of ``indel``, in order."""
    own = {"snp": SNP_RULES, "indel": INDEL_RULES}[variant_type]
    return sorted(parse_rules(SHARED_RULES + own), key=lambda r: (r.tier, r.order))


def rule_descriptions(rules: list[Rule]) -> dict[str, str]:
    """What each rule says, by its name."""
    return {r.name: r.description for r in sorted(rules, key=lambda r: (r.tier, r.order))}


#: The rules about splicing and transcript ends that the tests of the engine use.
SPLICE_RULES = [r for r in published_rules("snp") if r.name in ("SPLICE_SITE_DESTROYED", "START_LOSS", "STOP_CODON_DISRUPTION", "CRYPTIC_SPLICE_GAIN", "SPLICE_INDUCED_EXONIZATION", "SPLICE_INDUCED_INTRON_RETENTION", "EXON_LOSS")]
