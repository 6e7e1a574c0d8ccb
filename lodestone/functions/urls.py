"""URLs of git hosts: normal form, provider, host, credentials and permalinks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVIDERS = ("github", "gitlab", "gitea", "bitbucket", "generic")

# How each kind of host writes the page of a file's lines, as path, mark of lines and link of two lines.
# A gitea host has another path where the reference is a branch.
LINKS = {
    "github": ("/blob/", "#L", "-L"),
    "generic": ("/blob/", "#L", "-L"),
    "gitlab": ("/-/blob/", "#L", "-"),
    "gitea": ("/src/commit/", "#L", "-L"),
    "bitbucket": ("/src/", "#lines-", ":"),
}
BRANCH_PATH = {"gitea": "/src/branch/"}

# The user names that hosts take beside a token where none is given.
TOKEN_USERS = {"github": "x-access-token", "gitlab": "oauth2", "bitbucket": "x-token-auth"}


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def normalize(url: Column) -> Column:
    """``git@host:path`` as ``https://host/path``, else the trimmed URL; null as empty."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.regexp_replace(u, r"^git@([^:\s]+):(?=\S)", "https://$1/")


def provider_of_host(name: Column) -> Column:
    """The provider that a lower-case name holds."""
    return (
        F.when(name.contains("gitlab"), "gitlab")
        .when(name.contains("gitea") | name.contains("forgejo"), "gitea")
        .when(name.contains("bitbucket"), "bitbucket")
        .when(name.contains("github"), "github")
        .otherwise("generic")
    )


def provider(url: Column, explicit: Column | None = None) -> Column:
    """A valid explicit provider, else by the name that the URL holds."""
    found = provider_of_host(F.lower(normalize(url)))
    if explicit is None:
        return found
    e = F.lower(F.trim(explicit))
    return F.when(e.isin(*PROVIDERS), e).otherwise(found)


def host(url: Column, keep_port: bool = False) -> Column:
    """The lower-cased host; with ``keep_port`` a numeric port stays, so credentials saved for host:port are found."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"^(git@|https?://)", "")
    if keep_port:
        return F.lower(F.regexp_extract(u, r"^([^/:]*(?::[0-9]+(?=/|$))?)", 1))
    return F.lower(F.regexp_extract(u, r"^([^/:]*)", 1))


def address(url: Column) -> Column:
    """(host, port, secure) of a store's URL; without a scheme it is http. The port is null where none is given."""
    u = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(F.instr(u, "://") > 0, u).otherwise(F.concat(F.lit("http://"), u))
    port = F.regexp_extract(full, r"^[^:]+://(?:[^/@?#]*@)?[^/:?#]*:([0-9]+)(?:[/?#]|$)", 1)
    name = F.lower(F.regexp_extract(full, r"^[^:]+://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return F.struct(F.nullif(name, F.lit("")).alias("host"), port.try_cast("int").alias("port"), F.lower(full).startswith("https://").alias("secure"))


def sanitize(url: Column) -> Column:
    """Without credentials: ``***`` stands for what precedes the @ of an http(s) URL's host, wherever in a text it is."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"(?<=https?://)[^@/]+@", "***")


def repository_key(url: Column) -> Column:
    """What two URLs of one repository have in common: normal form without trailing slashes and ``.git``."""
    return F.regexp_replace(F.regexp_replace(normalize(url), r"/+$", ""), r"\.git$", "")


def _quoted(c: Column) -> Column:
    """Percent-encoding in which only letters, digits and ``_.-~`` stay."""
    e = F.url_encode(F.trim(c))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def authenticated(url: Column, token: Column, user: Column, explicit: Column | None = None) -> Column:
    """An http(s) URL with credentials in the provider's form; other URLs and empty credentials leave it as it is."""
    clean = normalize(url)
    t, u, p = F.when(_filled(token), _quoted(token)), F.when(_filled(user), _quoted(user)), provider(clean, explicit)
    colon = lambda a, b: F.concat(a, F.lit(":"), b)
    alone = lambda name: F.coalesce(colon(F.coalesce(u, F.lit(TOKEN_USERS[name])), t), u)
    auth = (
        F.when(p == "github", F.coalesce(colon(F.lit(TOKEN_USERS["github"]), t), u))
        .when(p == "gitlab", alone("gitlab"))
        .when(p == "bitbucket", alone("bitbucket"))
        .otherwise(F.coalesce(colon(u, t), t, u))
    )
    scheme = F.regexp_extract(clean, r"^(https?://)", 1)
    rest = F.regexp_replace(F.regexp_replace(clean, r"^https?://", ""), r"^[^@]+@", "")
    return F.when((_filled(token) | _filled(user)) & (scheme != ""), F.concat(scheme, auth, F.lit("@"), rest)).otherwise(clean)


def permalink(url: Column, sha: Column, path: Column, first: Column, last: Column, explicit: Column | None = None) -> Column:
    """The page of a file's lines at a commit, or branch main without one; null without a URL."""
    base = repository_key(url)
    p = provider(base, explicit)
    part = lambda i: F.element_at(F.create_map(*[F.lit(x) for name, link in LINKS.items() for x in (name, link[i])]), p)
    path_ = part(0)
    for name, other in BRANCH_PATH.items():
        path_ = F.when((p == name) & ~_filled(F.coalesce(sha, F.lit(""))), F.lit(other)).otherwise(path_)
    ref = F.when(_filled(sha), sha).otherwise(F.lit("main"))
    span = F.when(last > first, F.concat(part(2), last.cast("string"))).otherwise(F.lit(""))
    lines = F.when(first.isNotNull(), F.concat(part(1), first.cast("string"), F.coalesce(span, F.lit("")))).otherwise(F.lit(""))
    return F.when(_filled(url), F.concat(base, path_, ref, F.lit("/"), F.regexp_replace(path, r"^/+", ""), lines))


PROVIDER_LABELS = {"github": "GitHub", "gitlab": "GitLab", "gitea": "Gitea", "bitbucket": "Bitbucket", "generic": "Git"}


def provider_label(link: Column) -> Column:
    """The name to show for a permalink's provider."""
    p, out = provider(link), F.lit("Git")
    for key, label in PROVIDER_LABELS.items():
        out = F.when(p == key, F.lit(label)).otherwise(out)
    return out
