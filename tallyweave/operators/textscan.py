"""Scanners over text columns: lines, symbols, pattern findings, and what becomes of findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S


@dataclass(frozen=True)
class Pattern:
    """What a pattern stands for. Patterns avoid look-around, so that other regular expression engines agree.

    One of ``needs`` stands in every match, if there are any: a search for it, which is far cheaper, comes first.
    """

    name: str
    family: str
    regex: str
    severity: str
    weak: bool = True
    quantum_vulnerable: bool = False
    needs: tuple[str, ...] = ()

    def within(self, text: Column) -> Column:
        """Whether a text holds a match."""
        some = F.lit(False)
        for word in self.needs:
            some = some | text.contains(word)
        match = text.rlike(S.ascii_words(self.regex))
        return some & match if self.needs else match


# Patterns of weak or vulnerable algorithms and of secrets.
ALGORITHMS = (
    Pattern("MD5", "Hash", r"\bMD5\b|MD5\.Create|MD5CryptoServiceProvider", "High", needs=("MD5",)),
    Pattern("SHA1", "Hash", r"\bSHA1\b|SHA1\.Create|SHA1Managed|SHA1CryptoServiceProvider", "High", needs=("SHA1",)),
    Pattern("DES", "Symmetric", r"\bDES\b|DESCryptoServiceProvider|TripleDES|\b3DES\b", "High", needs=("DES",)),
    Pattern("RC2", "Symmetric", r"\bRC2\b|RC2CryptoServiceProvider", "High", needs=("RC2",)),
    Pattern("RC4", "Symmetric", r"\bRC4\b|ARC4", "Critical", needs=("RC4",)),
    Pattern("RSA", "AsymmetricRSA", r"\bRSA\b|RSACryptoServiceProvider|RSA\.Create", "Medium", False, True, needs=("RSA",)),
    Pattern("ECDSA", "AsymmetricECC", r"\bECDsa\b|ECDsa\.Create|ECDH", "Medium", False, True, needs=("ECD",)),
    Pattern("DSA", "AsymmetricDSA", r"\bDSA\b|DSACryptoServiceProvider", "High", True, True, needs=("DSA",)),
    Pattern("MD4", "Hash", r"\bMD4\b", "Critical", needs=("MD4",)),
)
SECRETS = (
    Pattern("connection-string", "Secret", r"(?s)(Server|Data\s+Source)\s*=.*?(Integrated\s+Security|Password|Pwd)\s*=", "Medium", needs=("Server", "Data")),
    Pattern("inline-password", "Secret", r"""(?i)\b(password|pwd)\s*=\s*["'][^"']+["']""", "High", needs=("=",)),
    Pattern("api-key", "Secret", r"""(?i)\b(api[_-]?key|secret[_-]?key|access[_-]?token)\s*[:=]\s*["'][^"']+["']""", "High", needs=('"', "'")),
)
# Fixed value: a credential in a connection string or an assignment.
EMBEDDED_SECRET = r"""(?i)(Password|Pwd|AccountKey|SharedAccessKey|ApiKey|Token)\s*=\s*["']?[^";'\s]{3,}"""
#: Credentials set in prose or configuration, a rule of this library: whole words, and a value that must be quoted.
ASSIGNED_SECRET = Pattern("assigned-secret", "Secret", r"""(?i)\b(password|pwd|accountkey|sharedaccesskey|apikey|api_key|secret|token)\s*[=:]\s*["'][^"';\s]{3,}""", "High", needs=('"', "'"))

# Control keywords of each language family.
KEYWORDS_SCRIPT = (r"\bif\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"&&", r"\|\|", r"\?")
KEYWORDS_SQL = (r"\bIF\b", r"\bWHILE\b", r"\bCASE\b", r"\bCURSOR\b", r"\bMERGE\b", r"\bWHEN\b", r"\bBEGIN\b")
KEYWORDS_BASIC = (r"\bIf\b", r"\bFor\b", r"\bWhile\b", r"\bDo\b", r"\bSelect\s+Case\b", r"\bGoTo\b", r"\bElseIf\b")
# Declarations, by language.
SCRIPT_FUNCTION = r"function\s+([A-Za-z_$][\w$]*)\s*\("
SQL_PROCEDURE, SQL_TABLE = r"(?i)CREATE\s+PROCEDURE\s+([\[\]\w\.]+)", r"(?i)CREATE\s+TABLE\s+([\[\]\w\.]+)"
BASIC_PROCEDURE = r"(?i)(?:Public|Private|Friend)?\s*(?:Static\s+)?(?:Sub|Function)\s+([A-Za-z_]\w*)\s*\("
# Constructions that a security review looks for, line by line.
HTML_BUILDING = r"""(['"]<[a-zA-Z][^'"]*['"]\s*\+)|(\.html\s*\(\s*[a-zA-Z_$])|(innerHTML\s*=)"""
BLOB_PARSING = r"(?i)STRING_SPLIT\s*\(|CHARINDEX\s*\(|SUBSTRING\s*\("
DYNAMIC_SQL = r"(?i)EXEC\s*\(\s*@|sp_executesql\s+@"
CONNECTION_LITERAL = r"(?i)\"[^\"]*\b(Server|Data\s*Source|Initial\s*Catalog|Integrated\s+Security)\s*=[^\"]*\""
CERTIFICATE_BYPASS = r"(?i)TrustServerCertificate\s*=\s*true"
COMMAND, CONCATENATION = r"new\s+SqlCommand\s*\(", r"\"[^\"]*\"\s*\+|\+\s*\"[^\"]*\""
COMMENT = r"^\s*(--|//|/\*|\*)"


def lines(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row for each line: the kept columns, ``line_no`` from 1, ``line``."""
    return docs.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")).select(*keep, (F.col("at") + 1).alias("line_no"), "line")


def not_comment() -> Column:
    return ~F.col("line").rlike(COMMENT)


def findings(docs: DataFrame, text: str, key: str, patterns: tuple[Pattern, ...], *, skip_comments: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each line and pattern that meet: key, kept columns, line_no, name, family, severity and flags.

    Texts in which no pattern matches anywhere are left out before they are cut into lines: a pattern that matches a
    line matches the text. Each line left is matched against all patterns in one pass.
    """
    hit = [
        F.when(
            p.within(F.col("line")),
            F.struct(F.lit(p.name).alias("name"), F.lit(p.family).alias("family"), F.lit(p.severity).alias("severity"), F.lit(p.weak).alias("weak"), F.lit(p.quantum_vulnerable).alias("quantum_vulnerable")),
        )
        for p in patterns
    ]
    some = F.lit(False)
    for p in patterns:
        some = some | p.within(F.col(text))
    rows = lines(docs.where(some), text, key, *keep)
    rows = rows.where(not_comment()) if skip_comments else rows
    return rows.select(key, *keep, "line_no", F.inline(F.array_compact(F.array(*hit))))


def whole_text_findings(docs: DataFrame, text: str, key: str, patterns: tuple[Pattern, ...]) -> DataFrame:
    """A row for each match of each pattern in a whole text, which may span lines: key, line_no, name, family, severity, matched.

    ``line_no`` is the line in which the match starts. Matches of a pattern do not overlap; the text is split before
    each of them, and the lines of the parts before it are counted.
    """
    mark = "\u0001"
    made = []
    for p in patterns:
        regex = S.ascii_words(p.regex)
        parts = F.split(F.regexp_replace(F.replace(F.col(text), F.lit(mark), F.lit(" ")), f"({regex})", f"{mark}$1"), mark)
        breaks = F.transform(parts, lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))))
        found = F.regexp_extract_all(F.replace(F.col(text), F.lit(mark), F.lit(" ")), F.lit(f"({regex})"), F.lit(1))

        def row(m: Column, i: Column, p: Pattern = p, breaks: Column = breaks) -> Column:
            before = F.aggregate(F.slice(breaks, F.lit(1), i + 1), F.lit(0), lambda s, n: s + n)
            return F.struct((before + 1).alias("line_no"), F.lit(p.name).alias("name"), F.lit(p.family).alias("family"), F.lit(p.severity).alias("severity"), m.alias("matched"))

        made.append(F.when(p.within(F.col(text)), _numbered(found, row)).otherwise(F.array().cast("array<struct<line_no: int, name: string, family: string, severity: string, matched: string>>")))
    return docs.select(key, F.inline(F.concat(*made)))


def _numbered(values: Column, row) -> Column:
    """``row`` of every value and its place from 0."""
    return F.transform(values, lambda m, i: row(m, i))


def highest_per_place(found: DataFrame, key: str) -> DataFrame:
    """Of the findings of one line and family the most severe stays; ties go to the name that comes first."""
    w = Window.partitionBy(key, "line_no", "family").orderBy(S.severity_rank(F.col("severity")).desc(), "name")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_lines(docs: DataFrame, text: str, key: str, regex: str) -> DataFrame:
    """Rows (key, first_line, n_lines) of the texts with a matching line that is not a comment.

    Works within the text's array of lines, so nothing is shuffled.
    """
    numbered = F.transform(F.split(F.col(text), "\n"), lambda s, i: F.struct((i + 1).alias("no"), s.alias("s")))
    hits = F.filter(numbered, lambda e: e["s"].rlike(regex) & ~e["s"].rlike(COMMENT))
    return docs.select(key, hits.alias("h")).where(F.size("h") > 0).select(key, F.col("h")[0]["no"].alias("first_line"), F.size("h").alias("n_lines"))


def symbols(docs: DataFrame, text: str, key: str, regex: str) -> DataFrame:
    """Rows (key, line_no, symbol): first groups of all matches of a declaration, one for each line and match."""
    return lines(docs, text, key).select(key, "line_no", F.explode(F.regexp_extract_all("line", F.lit(regex), F.lit(1))).alias("symbol"))


def dispositions(before: DataFrame, after: DataFrame, rule: str, in_scope: Column) -> DataFrame:
    """What became of findings: out of scope, residual where the rule still fires in ``after``, else remediated."""
    still = after.select(F.col(rule).alias("__r")).distinct()
    out = before.join(still, F.col(rule) == F.col("__r"), "left")
    return out.withColumn("disposition", F.when(~in_scope, "OutOfScope").when(F.col("__r").isNotNull(), "Residual").otherwise("Remediated")).drop("__r")


@dataclass(frozen=True)
class Rule:
    """A recogniser: its category, its statement, the confidence, and the condition on a text."""

    name: str
    category: str
    statement: str
    confidence: float
    when: Column


def recognise(docs: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """Rows (key, rule, category, statement, confidence) of the rules whose condition holds."""
    made = [
        F.when(r.when, F.struct(F.lit(r.name).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.statement).alias("statement"), F.lit(r.confidence).alias("confidence")))
        for r in rules
    ]
    return docs.select(key, F.inline(F.array_compact(F.array(*made))))


@dataclass(frozen=True)
class Structure:
    """A recogniser of a construction in a source text: all of its patterns occur."""

    name: str
    category: str
    confidence: float
    patterns: tuple[str, ...]


# Ids, categories and confidences of the twelve recognisers, and the names by which they know a construction.
STRUCTURAL = (
    Structure("great-circle-leg-distance", "Calculation", 0.92, (r"EarthRadius", r"\.Sqrt\s*\(")),
    Structure("total-distance-sum", "Calculation", 0.9, (r"(?i)\w*total\w*\s*\+=",)),
    Structure("estimated-time-on-target", "Calculation", 0.85, (r"launchEpochSec", r"NominalSpeed")),
    Structure("anti-meridian-wrap", "Calculation", 0.9, (r"\b360\b", r"\b180\b", r"\bwhile\s*\(")),
    Structure("leg-degree-box-feasibility", "Validation", 0.9, (r"MaxLegDLat", r"MaxLegDLon")),
    Structure("turn-rate-limit", "Validation", 0.9, (r"MaxTurnDeg",)),
    Structure("tot-tolerance", "Validation", 0.9, (r"TotTol", r"\bAbs\b", r"desiredTot")),
    Structure("route-validity-aggregate", "Validation", 0.85, (r"\brouteValid\s*=\s*false\b",)),
    Structure("sequential-waypoint-legs", "Routing", 0.85, (r"\[i ?\+ ?1\]", r"\bfor\s*\(")),
    Structure("mst-surface-only-tasking", "Constraint", 0.93, (r"""==\s*"[^"]+"\s*&&[^;]*==\s*"[^"]+""", r"(?i)goNoGo")),
    Structure("weapon-max-range-by-variant", "Constraint", 0.85, (r"Dictionary<string, double>", r"\b900\b")),
    Structure("max-leg-length", "Constraint", 0.8, (r"MaxLegNm|MAX_LEG_NM",)),
)


def structural_rules(text: str) -> list[Rule]:
    """The recognisers as rules on a column of source texts."""
    made = []
    for s in STRUCTURAL:
        when = F.lit(True)
        for p in s.patterns:
            when = when & F.col(text).rlike(S.ascii_words(p))
        made.append(Rule(s.name, s.category, s.name.replace("-", " "), s.confidence, when))
    return made
