import hashlib
import hmac
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.functions import ids, languages, register, stems, text, urls


def _one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


C = F.col


@pytest.mark.parametrize(
    ("url", "explicit", "want"),
    [
        ("https://github.com/o/r", None, "github"), ("git@gitlab.com:o/r.git", None, "gitlab"), ("https://forgejo.x/o/r", None, "gitea"), ("https://gitea.x/r", None, "gitea"),
        ("https://bitbucket.org/o/r", None, "bitbucket"), ("https://x.org/r", None, "generic"), ("https://x.org/r", " GitLab ", "gitlab"), ("https://github.com/r", "bogus", "github"), ("", None, "generic"), (None, None, "generic"),
    ],
)
def test_provider(spark, url, explicit, want):
    assert _one(spark, urls.provider(C("u").cast("string"), C("e").cast("string")), u=url, e=explicit) == want


@pytest.mark.parametrize(
    ("url", "sha", "first", "last", "want"),
    [
        ("https://github.com/o/r.git", "abc", 3, 9, "https://github.com/o/r/blob/abc/a/b.py#L3-L9"), ("git@gitlab.com:o/r.git", None, 3, 9, "https://gitlab.com/o/r/-/blob/main/a/b.py#L3-9"),
        ("https://gitea.x/o/r/", "s", 3, 3, "https://gitea.x/o/r/src/commit/s/a/b.py#L3"), ("https://gitea.x/o/r", None, None, None, "https://gitea.x/o/r/src/branch/main/a/b.py"),
        ("https://bitbucket.org/o/r", "s", 1, 2, "https://bitbucket.org/o/r/src/s/a/b.py#lines-1:2"), ("", "s", 1, 2, None),
    ],
)
def test_permalink(spark, url, sha, first, last, want):
    link = urls.permalink(C("u"), C("s").cast("string"), F.lit("/a/b.py"), C("a").cast("int"), C("z").cast("int"))
    assert _one(spark, link, u=url, s=sha, a=first, z=last) == want


@pytest.mark.parametrize(("token", "want"), [(None, "None"), ("", "None"), ("short", "****"), ("ghp_123456789cdef", "ghp_...cdef")])
def test_mask(spark, token, want):
    assert _one(spark, text.mask_token(C("t").cast("string")), t=token) == want


def test_hosts(spark):
    assert _one(spark, urls.host(C("u")), u="git@Code.example:o/r") == "code.example"
    assert _one(spark, urls.host(C("u")), u="https://h.example:8443/r") == "h.example"
    assert _one(spark, urls.host(C("u"), keep_port=True), u="https://h.example:8443/r") == "h.example:8443"
    assert _one(spark, urls.sanitize(C("u")), u="https://u:p@h/r") == "https://***h/r"


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://u:p@H.example:8443/x", ("h.example", 8443, True)), ("h:80", ("h", 80, False)), ("http://h/a:9", ("h", None, False)), ("h", ("h", None, False)), ("", (None, None, False)), (None, (None, None, False))],
)
def test_store_addresses(spark, url, want):
    assert tuple(_one(spark, urls.address(C("u").cast("string")), u=url)) == want


# Words and stems that the algorithm's description gives.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "valenci": "valenc", "digitizer": "digit",
    "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "revival": "reviv", "adjustment": "adjust",
    "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "öl": "öl", "a1s": "a1s",
}


def test_stems(spark):
    got = _one(spark, stems.stemmed(F.array(*[F.lit(w) for w in STEMS])))
    assert dict(zip(STEMS, got)) == STEMS


def test_ids(spark):
    assert _one(spark, ids.chunk_id(C("r"), C("p"), F.lit(3)), r="r", p="a/é.md") == str(uuid.uuid5(ids.NAMESPACE, "r:a/é.md#3"))
    known = str(uuid.uuid4())
    assert _one(spark, ids.point_id(C("i")), i=known.upper()) == known
    assert _one(spark, ids.point_id(C("i")), i="name") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "name"))


@pytest.mark.parametrize("secret", ["s", "k" * 100])
def test_hmac(spark, secret):
    want = hmac.new(secret.encode(), "héllo".encode(), hashlib.sha256).hexdigest()
    assert _one(spark, ids.hmac_sha256(secret, C("m")), m="héllo") == want
    for header, valid in ((f"sha256={want}", True), (want, True), (f"sha256={want[1:]}", False), (None, False)):
        assert _one(spark, ids.signature_valid(secret, C("m"), C("h").cast("string")), m="héllo", h=header) is valid


@pytest.mark.parametrize(
    ("path", "lang", "kind", "read"),
    [("a/b.PY", "python", "code", False), ("x.tsx", "tsx", "code", True), ("x.hpp", "cpp", "code", False), ("readme.md", "markdown", "doc", True), (".gitignore", "text", "doc", False), ("Makefile", "text", "doc", False), ("a.b/c", "text", "doc", False), ("q.sql", "sql", "code", True), ("c.toml", "toml", "doc", False)],
)
def test_languages(spark, path, lang, kind, read):
    p = C("p")
    row = spark.range(1).select(F.lit(path).alias("p")).select(languages.language(p), languages.doc_type(languages.language(p)), languages.is_read(p)).first()
    assert tuple(row) == (lang, kind, read)


@pytest.mark.parametrize(("value", "pattern", "want"), [("Äpfel", "%ä%", False), ("ABC", "a_c", True), ("a\\b", "a\\b", True), ("a%b", "A%B", True), ("data.py", "%a.py", True), ("x", "", False)])
def test_sqlite_like(spark, value, pattern, want):
    assert _one(spark, text.sqlite_like(C("v"), pattern), v=value) is want


def test_strip(spark):
    s = "\x1c\u2003 \xa0a b\x85\n"
    assert _one(spark, text.strip(C("s")), s=s) == s.strip()


def test_keyword_tokens(spark):
    got = _one(spark, text.keyword_tokens(C("s")), s="The FastAPI fastapi don't 123 ab1 snake_case x-y --- import ёж")
    assert got == ["fastapi", "fastapi", "don", "ab1", "snake_case", "x-y", "---"]


@pytest.mark.parametrize(("value", "want"), [("30", 30), ("-5", 0), ("x", 15), (None, 15)])
def test_interval(spark, value, want):
    assert _one(spark, text.interval_minutes(C("v").cast("string")), v=value) == want


def test_sql_functions(spark):
    assert "cosine_similarity" in register.register(spark)
    row = spark.sql("SELECT round(cosine_similarity(array(1D, 0D), array(1D, 1D)), 4), rrf_score(1, 60), mask_token('0123456789'), normalize_git_url('git@h:o/r'), sanitize_url('http://a@h')").first()
    assert tuple(row) == (0.7071, 1 / 61, "0123...6789", "https://h/o/r", "http://***h")
