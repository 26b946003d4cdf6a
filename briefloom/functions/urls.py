"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track where a reader came from.
TRACKING_PARAMETERS = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source")
# Names whose values are secret (compared without "-" and "_"), and the forms of tokens.
SECRET_PARAMETERS = (
    "token accesstoken apikey key signature sig secret auth authorization xamzsignature xgoogsignature credential securitytoken "
    "sessiontoken password clientsecret accesskey awsaccesskey awsaccesskeyid awssecretaccesskey awssecuritytoken awssessiontoken "
    "xamzcredential xamzsecuritytoken gcpcredential gcpsecuritytoken googleaccesstoken gcpaccesstoken googcredential googsecuritytoken "
    "xgoogcredential xgoogsecuritytoken"
).split()
TOKEN_FORMS = r"(?i)sk-[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}"

#: https links with a name as host, no port, and no character that has to be looked at.
PLAIN_URL = r"^https://[A-Za-z0-9.-]+(?:[/?#][\x21-\x7e]*)?\z"
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host name without credentials and port; empty if there is none."""
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::\d*)?$", 1))


def _recoded(text: Column) -> Column:
    """Decoded and encoded again, as a form encoder does: `~` stays, `*` does not."""
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query(url: Column) -> Column:
    def key(x: Column) -> Column:
        return F.regexp_extract(x, "^([^=]*)", 1)

    def kept(x: Column) -> Column:
        name = F.lower(F.coalesce(F.try_url_decode(key(x)), key(x)))
        return (x != "") & ~name.startswith("utm_") & ~name.isin(*TRACKING_PARAMETERS)

    pairs = F.filter(F.split(part(url, 4), "&"), kept)
    return F.array_join(F.transform(pairs, lambda x: F.concat(_recoded(key(x)), F.lit("="), _recoded(F.regexp_extract(x, "^[^=]*=(.*)$", 1)))), "&")


def canonical_url(url: Column) -> Column:
    """One spelling for all links to a page: lower-case scheme and host, no default port, no doubled or
    trailing slashes, no tracking parameters, no fragment.  http and https stay apart."""
    site = F.regexp_replace(F.lower(part(url, 2)), ":443$", "")
    path = F.regexp_replace(part(url, 3), "/{2,}", "/")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    own = F.when(scheme(url) == "", "https").otherwise(scheme(url))
    query = _query(url)
    return F.concat(own, F.lit("://"), site, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def stable_id(url: Column) -> Column:
    return F.substring(F.sha2(canonical_url(url), 256), 1, 16)


def is_evidence_url(url: Column) -> Column:
    """https, with a host, no credentials, a valid port, no control characters or white space, at most 256 bytes."""
    port = F.regexp_extract(part(url, 2), r":(\d*)$", 1)
    # most links are of this form, which needs no parts
    plain = F.coalesce(url.rlike(PLAIN_URL) & (F.octet_length(url) <= 256), F.lit(False))
    return plain | (
        url.isNotNull()
        & (url == F.trim(url))
        & (F.octet_length(url) <= 256)
        & ~url.rlike(r"[\x00-\x20\x7f]")
        & (scheme(url) == "https")
        & (host(url) != "")
        & ~part(url, 2).contains("@")
        & ((port == "") | F.coalesce(port.try_cast("int").between(0, 65535), F.lit(False)))
        & part(url, 2).rlike(r"^(\[[0-9A-Fa-f:.]+\]|[^:\[\]]+)(:\d*)?$")
    )


def _is_secret(name: Column) -> Column:
    return F.translate(F.lower(name), "-_", "").isin(*SECRET_PARAMETERS)


def redacted_url(url: Column) -> Column:
    """The URL without credentials and fragment; values of secret names are hidden in the query, after `=` or `:` in a path step and in
    the step after one that is such a name, and so are steps that hold a token.  One with a broken host is replaced by its hash."""

    def shown_pair(x: Column) -> Column:
        key = F.regexp_extract(x, "^([^=]*)", 1)
        value = F.when(_is_secret(F.coalesce(F.try_url_decode(key), key)), "REDACTED").otherwise(_recoded(F.regexp_extract(x, "^[^=]*=(.*)$", 1)))
        return F.concat(_recoded(key), F.lit("="), value)

    def step(done: Column, x: Column) -> Column:
        plain = F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
        named = F.regexp_extract(plain, "^([^=:]+[=:])", 1)
        assigned = (named != "") & _is_secret(F.rtrim(named, F.lit("=:")))
        shown = F.when(done["hide"], "REDACTED").when(assigned, F.concat(named, F.lit("REDACTED"))).when(plain.rlike(TOKEN_FORMS), "REDACTED").otherwise(x)
        return F.struct(F.concat(done["path"], F.array(shown)).alias("path"), (~done["hide"] & ~assigned & _is_secret(plain)).alias("hide"))

    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(False).alias("hide"))
    path = F.array_join(F.aggregate(F.split(part(url, 3), "/"), start, step, lambda x: x["path"]), "/")
    query = F.array_join(F.transform(F.filter(F.split(part(url, 4), "&"), lambda x: x != ""), shown_pair), "&")
    site = F.regexp_replace(part(url, 2), "^.*@", "")
    before = lambda mark, x: F.when(x == "", "").otherwise(F.concat(F.lit(mark), x))
    whole = F.concat(F.when(scheme(url) == "", "").otherwise(F.concat(scheme(url), F.lit(":"))), before("//", site), path, before("?", query))
    broken = site.contains("[") != site.contains("]")
    return F.when(broken, F.concat(F.lit("invalid-url:"), F.substring(F.sha2(url, 256), 1, 12))).otherwise(whole)
