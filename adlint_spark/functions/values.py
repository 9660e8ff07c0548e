"""Value predicates as columns. A null value gives a null answer unless the text says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Declared versions in order; a version's number is its place here.
VERSIONS = ("2.0", "3.0", "4.0", "4.1", "4.2", "4.3", "4.4")

HHMMSS = r"^[0-9]{2,}:[0-5][0-9]:[0-5][0-9](\.[0-9]{3})?$"

# Macro names.
MACROS = (
    "ADCATEGORIES ADCOUNT ADPLAYHEAD ADSERVINGID ADTYPE APIFRAMEWORKS APPBUNDLE ASSETURI BLOCKEDADCATEGORIES BREAKMAXADLENGTH "
    "BREAKMAXADS BREAKMAXDURATION BREAKMINADLENGTH BREAKMINDURATION BREAKPOSITION CACHEBUSTING CLICKPOS CLIENTUA CONTENTID "
    "CONTENTPLAYHEAD CONTENTURI DEVICEIP DEVICEUA DOMAIN ERRORCODE EXTENSIONS GDPR GDPRCONSENT IFA IFATYPE INVENTORYSTATE LATLONG "
    "LIMITADTRACKING MEDIAMIME MEDIAPLAYHEAD OMIDPARTNER PAGEURL PLACEMENTTYPE PLAYERCAPABILITIES PLAYERSIZE PLAYERSTATE PODSEQUENCE "
    "REASON REGULATIONS SERVERSIDE SERVERUA TIMESTAMP TRANSACTIONID UNIVERSALADID VASTVERSIONS VERIFICATIONVENDORS"
).split()

# Tracking events by version.
EVENTS_4_1 = (
    "mute unmute pause resume rewind skip playerExpand playerCollapse loaded start firstQuartile midpoint thirdQuartile complete progress "
    "closeLinear creativeView acceptInvitation adExpand adCollapse minimize close overlayViewDuration otherAdInteraction interactiveStart"
).split()
EVENTS_4_0 = (
    "mute unmute pause resume rewind skip playerExpand playerCollapse start firstQuartile midpoint thirdQuartile complete progress "
    "creativeView acceptInvitation adExpand adCollapse minimize close overlayViewDuration otherAdInteraction acceptInvitationLinear timeSpentViewing"
).split()
EVENTS_3_0 = (
    "creativeView start midpoint firstQuartile thirdQuartile complete mute unmute pause rewind resume fullscreen exitFullscreen expand "
    "collapse acceptInvitation close skip progress acceptInvitationLinear closeLinear"
).split()
EVENTS_2_0 = (
    "creativeView start midpoint firstQuartile thirdQuartile complete mute unmute pause rewind resume fullscreen expand collapse acceptInvitation close"
).split()


def among(c: Column, values) -> Column:
    """Whether the value is one of a fixed list; null for null."""
    return F.array_contains(F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")"), c)


def trimmed(c: Column) -> Column:
    """Without white space at both ends. Elements' texts are so already."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def version_ord(version: Column) -> Column:
    """0 for 2.0 up to 6 for 4.4; null for others."""
    return (F.nullif(F.array_position(F.array(*map(F.lit, VERSIONS)), version), F.lit(0)) - 1).cast("int")


def is_hhmmss(c: Column) -> Column:
    return c.rlike(HHMMSS)


def is_percent_0_100(c: Column) -> Column:
    number = F.when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?%$"), F.rtrim(c, F.lit("%")).try_cast("double"))
    return F.coalesce(number.between(0, 100), F.lit(False)) & c.isNotNull()


def is_time_or_percent(c: Column) -> Column:
    return F.when(c.endswith("%"), is_percent_0_100(c)).otherwise(is_hhmmss(c))


def is_zero_duration(c: Column) -> Column:
    return F.substring_index(c, ".", 1).rlike(r"^0+:0+:0+$")


def is_time_offset(c: Column) -> Column:
    """VMAP timeOffset: start, end, #m from 1, n% or a time; trimmed."""
    c = trimmed(c)
    return c.isin("start", "end") | c.rlike(r"^#\+?0*[1-9][0-9]{0,18}$") | is_time_or_percent(c)


def is_break_type(c: Column) -> Column:
    return c.rlike(r"^(linear|nonlinear|display)(,(linear|nonlinear|display))*$")


def is_percent(c: Column) -> Column:
    return trimmed(c).rlike(r"^[0-9]+(\.[0-9]+)?%$")


def is_xs_boolean(c: Column) -> Column:
    return F.lower(trimmed(c)).isin("true", "false", "1", "0")


def is_xs_integer(c: Column) -> Column:
    return trimmed(c).rlike(r"^[+-]?[0-9]+$")


def is_currency(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z]{3}$")


def is_uri_like(c: Column) -> Column:
    """data: and about:blank, or an absolute URL: a scheme, and for web schemes a host without forbidden characters.

    An approximation of a full URL parse: ``https://[MACRO]/x`` has no valid host, brackets elsewhere are fine.
    """
    special = r"^(?i:https?|wss?|ftp):[/\\]*([^/\\?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/\\?#@:\[\]<>^|%\s]+)(:[0-9]*)?([/\\?#].*)?$"
    other = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:.*"
    web = c.rlike(r"^(?i:https?|wss?|ftp):")
    return c.startswith("data:") | (c == "about:blank") | F.when(web, c.rlike("(?s)" + special)).otherwise(c.rlike(other))


def is_simid(c: Column) -> Column:
    return F.upper(trimmed(c)) == "SIMID"


def is_simid_near_miss(c: Column) -> Column:
    return is_simid(c) & (c != "SIMID")


def is_data_uri(c: Column) -> Column:
    return F.lower(F.substring(c, 1, 5)) == "data:"


def data_uri_is_html(c: Column) -> Column:
    mime = F.lower(trimmed(F.regexp_extract(c, r"(?is)^data:([^;,]*)", 1)))
    return mime.isin("text/html", "application/xhtml+xml")


def simid_url_insecure(c: Column) -> Column:
    return F.lower(c).rlike(r"^(http://|javascript:|file:|ftp://|ws://)")


def taxonomy_host(c: Column) -> Column:
    """The lower-cased host of a taxonomy authority; null if it isn't well formed."""
    host = F.regexp_replace(trimmed(c), r"^https?://", "")
    host = F.regexp_replace(F.regexp_extract(host, r"^([^/?#]*)", 1), r"^www\.", "")
    fits = host.rlike(r"^[A-Za-z0-9.-]+$") & host.contains(".") & ~host.startswith(".") & ~host.endswith(".") & ~host.contains("..")
    return F.when(fits, F.lower(host))


def is_vendor_key(c: Column) -> Column:
    return trimmed(c).rlike(r"^([A-Za-z0-9.]*\.[A-Za-z0-9.]*-[A-Za-z0-9._-]+|[A-Za-z0-9.]*\.[A-Za-z0-9.]*/[A-Za-z0-9._-]+)$")


def is_omid_vendor(c: Column) -> Column:
    return F.lower(trimmed(c)).rlike(r"(^|[-/])omid$")


def is_mime(c: Column) -> Column:
    """A MIME type before any parameters: two tokens without wildcards."""
    return F.substring_index(trimmed(c), ";", 1).rlike(r"^[A-Za-z0-9!#$%&'+.^_`|~-]+/[A-Za-z0-9!#$%&'+.^_`|~-]+$")


def is_whole(c: Column) -> Column:
    """A whole number that isn't negative."""
    return trimmed(c).rlike(r"^\+?[0-9]+$")


def is_registry(c: Column) -> Column:
    """A registry's name, or a host with a dot and nothing else of a URL; an approximation of a full URL parse."""
    return c.rlike(r"^[A-Za-z0-9_-]+$") | (c.contains(".") & c.rlike(r"^[^/\\:?#@\s<>^|%\[\]]+$"))


def macro_tokens(c: Column) -> Column:
    """The names in ``[NAME]``: at most 48 of A-Z, a-z, 0-9 and _, with a letter."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[(?=[0-9_]*[A-Za-z])([A-Za-z0-9_]{1,48})\]"), 1)


def has_illegal_uri_char(c: Column) -> Column:
    return c.rlike(r"[ \"<>\\^`{}|\x00-\x1f\x7f]")


def valid_tracking_event(event: Column, ord_: Column) -> Column:
    """Whether the event is in its version's list; true if the version is unknown."""
    return (
        F.when(ord_ >= 3, among(event, EVENTS_4_1)).when(ord_ == 2, among(event, EVENTS_4_0)).when(ord_ == 1, among(event, EVENTS_3_0)).when(ord_ == 0, among(event, EVENTS_2_0)).otherwise(F.lit(True))
    )


def normalize_caller(c: Column) -> Column:
    """The trimmed caller; ``anonymous`` if it is null, empty, over 64 bytes or has other than ``[A-Za-z0-9._:-]``."""
    c = trimmed(c)
    return F.when(c.rlike(r"^[A-Za-z0-9._:-]{1,64}$"), c).otherwise(F.lit("anonymous"))
