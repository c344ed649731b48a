"""Identifier splitting, additive stems, and search words."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_STOP = """
a an and are as at be been being but by can class classes code could did do does done else explain file files find for from function functions get
how i if implement implementation implemented in into is it list me my not of on or our should show tell that the then these they this those to us usage
use used uses was we were what when where which who whom why will with would you
"""
STOPWORDS = frozenset(_STOP.split())
#: Words people say for what code calls otherwise; used on queries only.
LEXICON = {
    k: tuple(v.split())
    for k, _, v in (
        row.partition(": ")
        for row in """\
api: route controller endpoint handler rest graphql resolver rpc
auth: jwt token session oauth login signin credential bearer principal authenticate authorize passport
authentication: jwt token session oauth login signin authenticate credential bearer
authorization: permission role policy acl scope grant rbac authorize guard
billing: invoice subscription stripe plan usage charge
cache: redis memcached ttl invalidate memo lru
config: env settings dotenv configuration options
database: sql query orm repository entity migration postgres mysql mongo prisma sequelize
deployment: docker kubernetes helm terraform pipeline ci cd
email: smtp sendgrid mailer ses nodemailer template
encryption: crypto cipher aes rsa encrypt decrypt kms
logging: logger winston pino log trace span
login: signin authenticate session credential password
logout: signout session revoke invalidate
middleware: interceptor filter guard pipeline hook
migration: schema alter ddl flyway alembic knex
password: bcrypt argon hash salt credential
payment: stripe charge invoice checkout billing subscription refund paypal transaction
queue: sqs rabbit kafka celery bullmq job worker consumer producer publish subscribe
ratelimit: throttle quota bucket limiter
retry: backoff resilience circuit breaker
route: router endpoint controller path handler get post
search: elastic opensearch lucene index query
startup: bootstrap main init entrypoint server listen
telemetry: metric trace span opentelemetry prometheus observability
test: spec jest vitest pytest mock fixture assert
upload: multipart s3 blob storage bucket presigned
validation: schema zod joi yup validator pydantic sanitize
webhook: callback signature event delivery
websocket: socket ws realtime channel broadcast""".splitlines()
    )
}


def split_identifier(c: Column) -> Column:
    """Lower-case words of a camelCase, PascalCase, snake_case or kebab-case name."""
    s = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda w: w != "")


def stem(w: Column) -> Column:
    """The additive stem of a word, or null where it has none."""
    n = F.length(w)

    def cut(k: int) -> Column:
        return F.left(w, n - k)

    return (
        F.when(n < 4, F.lit(None).cast("string"))
        .when(w.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("sses"), cut(2))
        .when(w.rlike("(ch|sh|x|z|s)es$") & (n > 4), cut(2))
        .when(w.endswith("s") & ~w.rlike("(ss|us|is)$"), cut(1))
        .when(w.endswith("ing") & (n >= 7), cut(3))
        .when(w.endswith("ed") & (n >= 6), cut(2))
    )


def search_tokens(c: Column) -> Column:
    """Words of a text for the full-text index: letters and digits, lower case, no marks.

    Latin marks are stripped by ``translate``; it stays in generated code.
    """
    return F.regexp_extract_all(F.translate(F.lower(c), *_FOLD), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def _fold() -> tuple[str, str]:
    src, to = [], []
    for i in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(i))
        if len(base) > 1 and base[0].isalpha() and len(base[0]) == 1 and chr(i) == chr(i).lower():
            src.append(chr(i)), to.append(base[0])
    return "".join(src), "".join(to)


_FOLD = _fold()


def with_stems(words: Column) -> Column:
    """Words, each followed by its stem if it has one of at least two letters; first occurrences."""
    both = F.flatten(F.transform(words, lambda w: F.array(w, F.when(F.length(stem(w)) > 1, stem(w)))))
    return F.array_distinct(F.filter(both, lambda w: w.isNotNull()))


def search_text(path: Column, names: Column, doc: Column, source: Column) -> Column:
    """What is indexed of a chunk: its path, symbol names, comment, split identifiers with stems, and itself."""
    ids = F.slice(F.array_distinct(F.regexp_extract_all(source, F.lit("[A-Za-z_$][A-Za-z0-9_$]{2,}"), F.lit(0))), 1, 401)
    words = F.flatten(F.transform(F.array_union(ids, names), split_identifier))
    places = F.flatten(F.transform(F.split(path, r"[/\\\\.]"), split_identifier))
    split = with_stems(F.filter(F.concat(words, places), lambda w: F.length(w) > 1))
    parts = F.array(path, F.array_join(names, " "), F.coalesce(doc, F.lit("")), F.array_join(split, " "), source)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def name_affinity(name: Column, terms: list[str]) -> Column:
    """How well a name's words are the terms: the share of its words, and their number."""
    words = split_identifier(name)
    known = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    hit = F.size(F.filter(words, lambda w: F.array_contains(known, w)))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(hit / F.size(words) + hit)


# ----- queries as typed: driver side ------------------------------------------------
def py_split(name: str) -> list[str]:
    name = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", name))
    return [w.lower() for w in re.split("[^A-Za-z0-9]+", name) if w]


def py_stem(word: str) -> str | None:
    w, n = word.lower(), len(word)
    if n < 4:
        return None
    if w.endswith("ies") and n > 4:
        return w[:-3] + "y"
    if w.endswith("sses") or (n > 4 and re.search("(ch|sh|x|z|s)es$", w)):
        return w[:-2]
    if w.endswith("s") and not re.search("(ss|us|is)$", w):
        return w[:-1]
    if w.endswith("ing") and n >= 7:
        return w[:-3]
    return w[:-2] if w.endswith("ed") and n >= 6 else None


@dataclass(frozen=True)
class Query:
    """A typed query: its terms with stems, words the lexicon adds, quoted phrases."""

    text: str
    terms: tuple[str, ...]
    expanded: tuple[str, ...]
    phrases: tuple[str, ...]
    looks_like_symbol: bool

    def clauses(self) -> list[list[str]]:
        """Each alternative of the OR query as the words that must follow one another."""
        said = [*(p.replace('"', "") for p in self.phrases), *(re.sub(r'["*^:(){}\[\]]', "", t) for t in (*self.terms, *self.expanded))]
        return [w for w in (py_tokens(s) for s in dict.fromkeys(said)) if w]


def py_tokens(text: str) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", plain)


def analyse(query: str) -> Query:
    phrases: list[str] = []
    rest = re.sub('"([^"]+)"', lambda m: phrases.append(m[1].strip()) or " ", query)
    raw = [t for t in re.split("[^A-Za-z0-9_$.]+", rest) if t]
    one = raw[0] if len(raw) == 1 else ""
    symbol = bool(re.fullmatch("[A-Za-z_$][A-Za-z0-9_$.]*", one) and re.search("[A-Z_.]", one))
    terms: dict[str, None] = {}

    def add(word: str) -> None:
        if word in STOPWORDS or len(word) < 2:
            return
        terms[word] = None
        s = py_stem(word)
        if s and s != word and len(s) > 1:
            terms[s] = None

    for t in raw:
        add(t.lower())
        for w in py_split(t):
            add(w)
    more = dict.fromkeys(s for t in terms for s in LEXICON.get(t, ()) if s not in terms)
    return Query(query, tuple(terms), tuple(more)[:24], tuple(phrases), symbol)
