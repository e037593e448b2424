"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest looks at a candidate's length and characters, at its character
transitions against those of ordinary words, at how much of it dictionary
words cover, at the path it comes from and at the words beside it. It is
trained here from labelled findings: those a caller has, or the module's own,
which are the candidates in texts of a seeded generator.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import frugal, lean, slices, table

#: Labelled findings that the forest is fitted on at most, its trees and their depth.
FINDINGS, TREES, DEPTH = 6000, 40, 12
#: Characters on either side of a candidate that count as its neighbourhood.
NEAR = 48

#: Prefixes by which services mark their keys.
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "sk_live_", "rk_live_", "sk-", "SG.", "npm_", "pypi-", "eyJ", "hf_", "dop_v1_")
#: Words that name a secret, words that mark a stand-in, and parts of paths that hold examples.
NAMING = ("api", "apikey", "auth", "authorization", "bearer", "credential", "credentials", "key", "passphrase", "passwd", "password", "private", "pwd", "secret", "token")
STAND_IN = ("abc", "changeme", "dummy", "example", "fake", "foo", "insert", "lorem", "mock", "placeholder", "redacted", "sample", "test", "todo", "xxx", "your")
EXAMPLE_PATHS = ("doc", "example", "fixture", "mock", "readme", "sample", "spec", "test")
#: A dictionary of words that identifiers are made of.
WORDS = frozenset(
    "about access account action active address admin after agent alert alpha amount array asset async author average backup bank base batch before begin beta binary block body book branch bridge browser buffer build button cache call cancel card case channel chart check child class clean client clock close cloud code color column command commit common config connect console const container content context control copy core count country create current custom data database date debug default delete depth design detail device direct disk display document domain double down draft drive driver edge edit email empty enable encode engine entry error event example exchange export extra factory fail feature field file filter final first fixed flag float folder format forward frame from full function future game gate general global graph green group guide handle hash header height help helper hidden history home host http https image import index info init input insert install instance integer internal item java job join json keep kernel label language large last layer layout left length level library light limit line link list load local lock log logic login long loop machine mail main make manager map mark master match memory menu merge message meta method middle mobile model module month more mouse move multi name native network next node none normal note null number object offset old only open option order origin other output over owner package page pair panel parent parse part patch path pattern payment people person phone place plain plan play plugin point policy pool port post power prefix present print private process product profile program project property proxy public push query queue quick random range rate read ready real record red ref region remote render report request reset resource response rest result return right role root round route rule run sample save scale scan schema scope score screen script search second section select send serial server service session set shape share shell short sign simple single site size small sort source space split stack stage start state static status step stop storage store stream string strong style submit success summary support switch sync system table target task team template term test text theme thread time title today tool total trace track train tree trigger type under unique unit update upload user util utils valid value vector version video view visible wait watch web week white width window with word work world write year zero zone".split()
)

_RUN = re.compile(r"[A-Za-z0-9_+/.=~$@!#%^&*-]{8,}")
#: Where a value starts inside a run: behind a sign that joins a name and a value, or two such pairs.
_JOINT = re.compile(r"(?<=[=&])(?=[^=&])")
_ASSIGNED = re.compile(r"""(?i)(?:\b[\w.-]*(?:api|auth|bearer|credential|key|passphrase|passwd|password|pwd|secret|token)[\w.-]*["'`]?\s{0,3}(?::=|=>|[:=])|\b(?:bearer|basic|token))\s{0,3}["'`]?\Z""")
_MIXED = re.compile(r"[0-9]")
_PREFIX = re.compile("|".join(rf"(?<![A-Za-z0-9]){re.escape(p)}" for p in PREFIXES))
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----\s+((?:[A-Za-z0-9+/=:,-]+\s+)+?)-----END")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Places of a text that may be secrets: from, to, and why (pem, prefix, assigned, random), in order.

    A run of the characters of keys is cut behind "=" and "&", so that a name
    before a value is not part of it, and starts at a service's prefix that
    stands inside it. Candidates are values of 16 characters with a prefix, of
    8 that are assigned to a name of a secret, of 16 with a digit, and what
    stands between the lines of a private key.
    """
    found = [(*m.span(1), "pem") for m in _PEM.finditer(text)]
    keys = [(a, b) for a, b, _ in found]
    for m in _RUN.finditer(text):
        cuts = [0, *(j.start() for j in _JOINT.finditer(m[0])), len(m[0])]
        for a, b in zip(cuts, cuts[1:]):
            piece = m[0][a:b]
            mark = _PREFIX.search(piece)
            if mark and len(piece) - mark.start() >= 16:
                a, piece = a + mark.start(), piece[mark.start() :]
            value = piece.strip("=&.,!-") if b < len(m[0]) or piece[-1] in ".,!-" or piece[0] in "=-" else piece
            start = m.start() + a + piece.find(value)
            end = start + len(value)
            if any(x <= start < y for x, y in keys):
                continue
            if mark and len(value) >= 16 and value.startswith(PREFIXES):
                found.append((start, end, "prefix"))
            elif len(value) >= 8 and text[start - 1 : start] in ("'", '"', "`", "=", ":", " ") and _ASSIGNED.search(text, max(0, start - NEAR), start):
                found.append((start, end, "assigned"))
            elif len(value) >= 16 and _MIXED.search(value):
                found.append((start, end, "random"))
    return sorted(found)


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@lru_cache(maxsize=1)
def _transitions() -> dict[str, float]:
    """Log probabilities of letter pairs in the dictionary's words, smoothed."""
    counts: dict[str, int] = {}
    starts: dict[str, int] = {}
    for w in WORDS:
        for a, b in zip(w, w[1:]):
            counts[a + b] = counts.get(a + b, 0) + 1
            starts[a] = starts.get(a, 0) + 1
    return {a + b: math.log((counts.get(a + b, 0) + 0.5) / (starts.get(a, 0) + 13)) for a in string.ascii_lowercase for b in string.ascii_lowercase}


def coverage(value: str) -> float:
    """Share of a candidate's characters that dictionary words of four letters or more cover, the longest taken first from the left."""
    low, i, covered = value.lower(), 0, 0
    while i < len(low):
        for n in range(min(10, len(low) - i), 3, -1):
            if low[i : i + n] in WORDS:
                covered += n
                i += n
                break
        else:
            i += 1
    return covered / max(1, len(low))


def features(value: str, before: str, after: str, path: str, why: str) -> list[float]:
    n = len(value)
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    kinds = [_class(c) for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    t = _transitions()
    letters = [t.get((a + b).lower(), -5.0) for a, b in zip(value, value[1:]) if a.isascii() and b.isascii() and a.isalpha() and b.isalpha()]
    repeats = sum(a == b for a, b in zip(value, value[1:])) / max(1, n - 1)
    steps = sum(ord(b) - ord(a) == 1 for a, b in zip(value, value[1:])) / max(1, n - 1)
    words = re.findall(r"[a-z]+", before.lower())[-6:]
    behind = re.findall(r"[a-z]+", after.lower())[:4]
    low = value.lower()
    return [
        n, entropy, entropy / math.log2(max(2, n)), changes, sum(letters) / len(letters) if letters else -4.0, len(letters) / max(1, n - 1), coverage(value), repeats, steps,
        *(kinds.count(k) / n for k in range(4)),
        float(all(c in "0123456789abcdef" for c in low)), float(value.isdigit()), float(n in (32, 40, 64)), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        float("@" in value[1:-1]), value.count(".") / n, value.count("/") / n, float(low.startswith(("http", "www."))),
        float(any(w in NAMING for w in words)), float(any(w in NAMING for w in behind)), float(any(w in STAND_IN for w in words + behind)), float(any(s in low for s in STAND_IN)),
        float(any(p in path.lower() for p in EXAMPLE_PATHS)), float(before.rstrip()[-1:] in ("=", ":", '"', "'", "`")), float(why == "prefix"), float(why == "assigned"), float(why == "pem"),
    ]


@dataclass
class Finding:
    value: str
    before: str
    after: str
    path: str
    why: str
    secret: bool


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[Finding]:
    """Labelled findings: what candidates() finds in generated texts, a secret if it is one that was put there.

    The generator plants secrets of common shapes, as they are assigned, sent
    or listed, and what looks like them; it knows nothing of any table.
    """
    r = random.Random(seed)
    out: list[Finding] = []
    while len(out) < n:
        text, planted, path = labelled_text(r)
        for start, end, why in candidates(text):
            secret = any(a < end and start < b for a, b in planted)
            out.append(Finding(text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR], path, why, secret))
    return out[:n]


def labelled_text(r: random.Random) -> tuple[str, list[tuple[int, int]], str]:
    """A text, the places of the secrets in it, and a path."""
    pool = sorted(WORDS)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    b62, hex_, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    prose = lambda low=1: " ".join(r.choice(pool) for _ in range(r.randint(low, 7)))
    path = r.choice(["app/config.py", ".env", "deploy/values.yaml", "lib/client.go", "web/index.js", "notes.txt", "mail/0001", "crawl/part-7", "", ""])
    joint = r.choice([" = ", ": ", "=", " := ", "=", " => "])
    name = r.choice(["", "my_", "app.", "X-", "AWS_", "db-"]) + r.choice(NAMING)
    quote = r.choice(["", '"', "'"])
    before, after = prose(), r.choice([" ", ", ", "\n", ". "]) + prose()
    if r.random() < 0.5:
        shape = r.randrange(9)
        value = [pick(hex_, r.choice([32, 40, 64])), pick(b62, r.randint(20, 48)), pick(b64, r.choice([40, 64])) + r.choice(["", "=", "=="]), r.choice(PREFIXES[:-4]) + pick(b62, r.randint(16, 40)), "eyJ" + pick(b62, 20) + "." + pick(b62, 40) + "." + pick(b62, 43), pick(b62 + "!#%&*", r.randint(10, 18)), pick(b62, r.randint(24, 44)), "", pick(hex_, 40)][shape]
        if shape in (3, 4) and r.random() < 0.5:
            head = f"{before} "
        elif shape == 6:
            head = f"{before}\nAuthorization: {r.choice(['Bearer', 'Basic', 'token'])} "
        elif shape == 7:
            value = "\n".join(pick(b64, 64) for _ in range(r.randint(2, 5))) + "\n"
            head, after = f"{before}\n-----BEGIN RSA PRIVATE KEY-----\n", "-----END RSA PRIVATE KEY-----\n" + prose()
        elif shape == 8:
            head = f"https://{r.choice(pool)}.example.com/{r.choice(pool)}?id={r.randint(1, 99)}&{r.choice(['token', 'api_key', 'secret'])}="
        else:
            head, after = f"{before} {name}{joint}{quote}", quote + after
        if r.random() < 0.03:
            path = r.choice(["tests/test_auth.py", "docs/example.md"])
        return head + value + after, [(len(head), len(head) + len(value))], path
    shape = r.randrange(11)
    if shape == 0:
        value = r.choice(["_", "-", "."]).join(r.choice(pool) for _ in range(r.randint(3, 6))) + str(r.randint(0, 999))
    elif shape == 1:
        value = "".join(r.choice(pool).title() for _ in range(r.randint(3, 5))) + str(r.randint(0, 99))
    elif shape == 2:
        value = "-".join(pick(hex_, k) for k in (8, 4, 4, 4, 12))
    elif shape == 3:
        value = pick(hex_, r.choice([32, 40, 64]))
    elif shape == 4:
        value = pick(string.digits, r.randint(16, 20))
    elif shape == 5:
        value = f"{r.choice(pool)}.{r.choice(pool)}{r.randint(1, 99)}@{r.choice(pool)}.example.com"
    elif shape == 6:
        value = f"/{r.choice(pool)}/{r.choice(pool)}-{r.randint(1, 9)}.{r.randint(0, 20)}/{r.choice(pool)}.{r.choice(['py', 'html', 'tar.gz'])}"
    elif shape == 7:
        value = r.choice(STAND_IN) + r.choice(["_", "-", ""]) + r.choice(pool) + pick(string.digits, r.randint(0, 4)) + r.choice(["", "_here"])
    elif shape == 8:
        value = r.choice(["_", ".", "-"]).join(r.choice(pool) for _ in range(r.randint(2, 4)))
    elif shape == 9:
        value = r.choice("xX*0") * r.randint(8, 40)
    else:
        value, path = pick(b62, r.randint(16, 40)), r.choice(["tests/test_auth.py", "docs/example.md", "fixtures/mock.json", "README.md"])
        before = r.choice(["example", "dummy", "fake", "sample"])
    head = f"{before} {name}{joint}{quote}" if shape >= 7 else before + r.choice([" ", " commit ", " sha256 ", " id ", " at ", f" {r.choice(pool)}="])
    return head + value + (quote if shape >= 7 else "") + after, [], path


class Forest:
    """A random forest for two classes: each tree grown on a bootstrap sample, a random root's worth of features tried at each split."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x[i], y[i].astype(float), depth, rng) for i in (rng.integers(0, len(x), len(x)) for _ in range(trees))]

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """Arrays feature (-1: leaf), limit, low, high, value of a tree's nodes."""
        nodes: list[list[float]] = []
        todo = [(np.arange(len(x)), depth, -1, 0)]
        tried = max(1, int(math.sqrt(x.shape[1])))
        while todo:
            rows, left, parent, side = todo.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = me
            share = y[rows].mean()
            nodes.append([-1, 0.0, 0, 0, share])
            if not left or len(rows) < 4 or share in (0.0, 1.0):
                continue
            best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], tried, replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, c = x[order, f], np.cumsum(y[order])
                k = np.flatnonzero(v[1:] > v[:-1]) + 1
                if not len(k):
                    continue
                low, total, n = c[k - 1], c[-1], len(rows)
                cost = low * (1 - low / k) + (total - low) * (1 - (total - low) / (n - k))
                i = int(cost.argmin())
                if cost[i] < best[0]:
                    best = (cost[i], int(f), (v[k[i] - 1] + v[k[i]]) / 2)
            if best[1] >= 0:
                nodes[me][:2] = best[1], best[2]
                goes = x[rows, best[1]] <= best[2]
                todo += [(rows[goes], left - 1, me, 0), (rows[~goes], left - 1, me, 1)]
        a = np.array(nodes)
        return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that rows come to."""
        total = np.zeros(len(x))
        for feature, limit, low, high, value in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                f = feature[at[i]]
                at[i] = np.where(x[i, f] <= limit[at[i]], low[at[i]], high[at[i]])
            total += value[at]
        return total / len(self.trees)


def train(findings: list[Finding] | None = None) -> Forest:
    """The forest for labelled findings, at most FINDINGS of them (the module's own where none are given)."""
    findings = (labelled_findings() if findings is None else findings)[:FINDINGS]
    x = np.array([features(f.value, f.before, f.after, f.path, f.why) for f in findings])
    return Forest(x, np.array([f.secret for f in findings]))


def scan_secrets(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, path: str = "source") -> DataFrame:
    """Every candidate of the texts of docs (doc_id, text, a path column if there) with the forest's verdict.

    Returns doc_id, start, end (code points), rule, value_sha256 (secrets are
    not copied on), score, secret (score of at least threshold). Null and
    empty texts have no candidates, a null path is empty, repeated rows are
    scanned each; an empty table gives no rows.
    """
    from pyspark.sql import functions as F

    lean(docs.sparkSession)
    forest = forest or train()
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", "text", (F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4_000_000):
            found, x = [], []
            for doc_id, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path"))):
                for start, end, why in candidates(text or ""):
                    value = text[start:end]
                    found.append((doc_id, start, end, why, hashlib.sha256(value.encode()).hexdigest()))
                    x.append(features(value, text[max(0, start - NEAR) : start], text[end : end + NEAR], at or "", why))
            if found:
                score = forest.scores(np.array(x))
                columns = list(zip(*found))
                kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(score), pa.array(score >= threshold)], ["doc_id", "start", "end", "rule", "value_sha256", "score", "secret"])

    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("rule", T.StringType()), T.StructField("value_sha256", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("secret", T.BooleanType())]
    )
    return rows.mapInArrow(frugal(run), schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all documents, with the verdict on each."""
    return scan_secrets(table(spark, sf_dir, "documents"))
