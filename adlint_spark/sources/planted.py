"""Ad documents with one planted defect each, so that SQL can tell every finding, with its place, from keys alone.

A sheet is a document that breaks no rule, written line by line, and a list of plants: other texts for some lines, and the
findings that follow from the standards. Document k of a sheet has plant number k modulo the number of plants plus one; the last is
the sheet as it is. Each line holds the start of one element at most, so line and column follow from the layout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlint_spark.sources.corpus import keyed_orders

LEVELS = {"E": "error", "W": "warning", "I": "info"}


@dataclass(frozen=True)
class Find:
    rule: str
    level: str
    path: str | None
    line: int | None
    spec: str
    col: int | None = 1


@dataclass(frozen=True)
class Plant:
    lines: dict[int, str]
    finds: tuple[Find, ...]
    repairs: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Sheet:
    name: str
    text: str
    plants: tuple[Plant, ...]

    @property
    def slots(self) -> int:
        return len(self.plants) + 1


def plant(lines: dict[int, str], *finds: tuple) -> Plant:
    return Plant(lines, tuple(Find(*f) if f[3] is not None else Find(*f[:5], col=None) for f in finds))


def planted_documents(spark: SparkSession, sf_dir: str, sheet: Sheet) -> DataFrame:
    """(doc_id, xml): a document of the sheet for each order; ``{k}`` in a line stands for the order's key."""
    lines = sheet.text.strip("\n").split("\n")
    slot = F.col("k") % sheet.slots
    columns = []
    for n, line in enumerate(lines, 1):
        text = F.lit(line)
        for j, p in enumerate(sheet.plants):
            if n in p.lines:
                text = F.when(slot == j, F.lit(p.lines[n])).otherwise(text)
        columns.append(text)
    _, orders = keyed_orders(spark, sf_dir)  # to all cores: keys fill few files, documents don't
    xml = F.replace(F.concat_ws("\n", *columns), F.lit("{k}"), F.col("k").cast("string"))
    return orders.select(F.col("k").cast("string").alias("doc_id"), xml.alias("xml"))


def planted_sql(sheet: Sheet) -> str:
    """The findings of all documents of a sheet, counted by rule and place, as SQL over the orders' keys."""
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = [
        f"({j}, {quote(f.rule)}, '{LEVELS[f.level]}', {quote(f.path)}, {'NULL' if f.line is None else f.line}, {'NULL' if f.col is None else f.col}, {quote(f.spec)})"
        for j, p in enumerate(sheet.plants) for f in p.finds
    ]
    return (
        f"SELECT rule_id, severity, path, line::INT AS line, col::INT AS col, spec_ref, count(*) AS n FROM orders JOIN (VALUES {', '.join(rows)}) AS f(slot, rule_id, severity, path, line, col, spec_ref) "
        f"ON o_orderkey % {sheet.slots} = slot GROUP BY ALL"
    )


INLINE = "/VAST/Ad[0]/InLine"
JULY = "IAB CTV Addendum 2024 (July 2024)"
_X = f"{INLINE}/Extensions/Extension"
_UID, _MEZ, _ICF, _ICON, _VERIFY = f"{_X}[0]/UniversalAdId", f"{_X}[1]/Mezzanine", f"{_X}[2]/InteractiveCreativeFile", f"{_X}[3]/Icon", f"{_X}[4]/AdVerifications"
_URL = "<![CDATA[https://ads.example.com/x]]>"

_ADDENDUM_TEXT = f"""
<VAST version="2.0">
<Ad id="a{{k}}">
<InLine>
<AdSystem version="1">acme</AdSystem>
<AdTitle>Spring sale {{k}}</AdTitle>
<Impression><![CDATA[https://ads.example.com/i/{{k}}]]></Impression>
<Creatives>
<Creative id="c1">
<Linear>
<Duration>00:00:30</Duration>
<TrackingEvents>
<Tracking event="start">{_URL}</Tracking>
</TrackingEvents>
<MediaFiles>
<MediaFile id="m1" delivery="progressive" type="video/mp4" width="640" height="360">{_URL}</MediaFile>
</MediaFiles>
</Linear>
</Creative>
</Creatives>
<Extensions>
<Extension type="UniversalAdId">
<UniversalAdId idRegistry="ad-id.org" creativeId="c1">A{{k}}</UniversalAdId>
</Extension>
<Extension type="Mezzanine">
<Mezzanine mediaFileId="m1" delivery="progressive" type="video/mp4" width="1920" height="1080">{_URL}</Mezzanine>
</Extension>
<Extension type="InteractiveCreativeFile">
<InteractiveCreativeFile mediaFileId="m1" type="text/html" apiFramework="SIMID" variableDuration="1">{_URL}</InteractiveCreativeFile>
</Extension>
<Extension type="Icon">
<Icon program="AdChoices" width="10" height="10" xPosition="left" yPosition="top" regs="1">
<StaticResource creativeType="image/png">{_URL}</StaticResource>
</Icon>
</Extension>
<Extension type="AdVerifications">
<AdVerifications>
<Verification vendor="a.example.com-omid">
<JavaScriptResource apiFramework="omid" browserOptional="true">{_URL}</JavaScriptResource>
<VerificationParameters><![CDATA[p]]></VerificationParameters>
</Verification>
</AdVerifications>
</Extension>
</Extensions>
</InLine>
</Ad>
</VAST>
"""

_MISPLACED = "VAST-2.0-extension-misplaced-element"
ADDENDUM = Sheet(
    "ctv_addendum",
    _ADDENDUM_TEXT,
    (
        # four of the types are for 2.0 only; then they are a vendor's
        plant(
            {1: '<VAST version="3.0">'},
            *(("VAST-2.0-ctv-extension-location", "W", f"{_X}[{n}]", line, JULY) for n, line in ((0, 21), (1, 24), (2, 27), (3, 30))),
            *((_MISPLACED, "W", f"{_X}[{n}]/{kid}", line, "IAB VAST 2.0 §2") for n, kid, line in ((0, "UniversalAdId", 22), (1, "Mezzanine", 25), (2, "InteractiveCreativeFile", 28), (3, "Icon", 31))),
            ("VAST-2.0-version-mismatch", "W", "/VAST", None, "IAB VAST 2.0 §2.1"),
        ),
        plant({22: "<Other/>"}, ("VAST-2.0-ctv-extension-payload", "E", f"{_X}[0]", 21, JULY)),
        plant({23: "text</Extension>"}, ("VAST-2.0-ctv-extension-payload", "E", f"{_X}[0]", 21, JULY)),
        plant({22: '<UniversalAdId creativeId="c1">A</UniversalAdId>'}, ("VAST-2.0-ctv-universaladid-registry", "E", _UID, 22, JULY)),
        plant({22: '<UniversalAdId idRegistry=" " creativeId="c1">unknown</UniversalAdId>'}),
        plant({22: '<UniversalAdId idRegistry=" " creativeId="c1">A</UniversalAdId>'}, ("VAST-2.0-ctv-universaladid-registry", "E", _UID, 22, JULY)),
        plant({22: '<UniversalAdId idRegistry="https://ad-id.org/x" creativeId="c1">A</UniversalAdId>'}, ("VAST-2.0-ctv-universaladid-registry-format", "W", _UID, 22, JULY)),
        plant({22: '<UniversalAdId idRegistry="ad-id.org" creativeId="c1"> </UniversalAdId>'}, ("VAST-2.0-ctv-universaladid-content", "E", _UID, 22, JULY)),
        plant({22: '<UniversalAdId idRegistry="ad-id.org" creativeId="c1" colour="red">A</UniversalAdId>'}, ("VAST-2.0-unknown-attribute", "W", f"{_UID}[@colour]", 22, "IAB VAST 2.0 §2")),
        plant({22: '<UniversalAdId idRegistry="ad-id.org" creativeId="c1">A<b/></UniversalAdId>'}, ("VAST-2.0-text-only-element", "E", f"{_UID}/b", 22, "IAB VAST 2.0 §2", 56)),
        plant({22: '<UniversalAdId idRegistry="ad-id.org" creativeId="c9">A</UniversalAdId>'}, ("VAST-2.0-ctv-binding-unmatched", "E", _UID, 22, JULY)),
        plant({22: '<UniversalAdId idRegistry="ad-id.org" creativeId="c1">A</UniversalAdId>', 19: '<Creative id="c1"><CompanionAds/></Creative></Creatives>'}, ("VAST-2.0-ctv-binding-unmatched", "E", _UID, 22, JULY)),
        plant({22: '<UniversalAdId idRegistry="ad-id.org">A</UniversalAdId>', 19: '<Creative id="c2"><CompanionAds/></Creative></Creatives>'}, ("VAST-2.0-ctv-binding-implicit", "I", _UID, 22, JULY)),
        plant({22: '<UniversalAdId idRegistry="ad-id.org">A</UniversalAdId>'}),
        plant({25: f'<Mezzanine mediaFileId="m1" delivery="progressive" type="video" width="wide" height="-1">{_URL}</Mezzanine>'}, *(("VAST-2.0-ctv-mezzanine-values", "E", f"{_MEZ}[@{a}]", 25, JULY) for a in ("width", "height", "type"))),
        plant({25: f'<Mezzanine mediaFileId="m1">{_URL}</Mezzanine>'}, *((f"VAST-4.1-mezzanine-{a}", "E", _MEZ, 25, "IAB VAST 4.1 §2.3.5.2") for a in ("delivery", "type", "width", "height"))),
        plant({25: '<Mezzanine mediaFileId="m1" delivery="download" type="video/mp4" width="1" height="+1"/>'}, ("VAST-2.0-mediafile-delivery-enum", "E", f"{_MEZ}[@delivery]", 25, "IAB VAST 2.0 §2.3.5.2"), ("VAST-2.0-url-empty", "E", _MEZ, None, "IAB VAST 2.0 §2")),
        plant({25: f'<Mezzanine mediaFileId="m2" delivery="streaming" type="video/mp4" width="1" height="1">{_URL}</Mezzanine>'}, ("VAST-2.0-ctv-binding-unmatched", "E", _MEZ, 25, JULY)),
        plant({28: f'<InteractiveCreativeFile mediaFileId="m1" apiFramework="simid" variableDuration="yes">{_URL}</InteractiveCreativeFile>'},
              ("VAST-2.0-ctv-interactive-api", "E", _ICF, 28, JULY), ("SIMID-1.0-simid-type-required", "E", _ICF, 28, JULY), ("VAST-2.0-ctv-interactive-duration", "E", _ICF, 28, JULY)),
        plant({28: '<InteractiveCreativeFile mediaFileId="m1" type="text/html" apiFramework="SIMID"/>'}, ("SIMID-1.0-simid-url-empty", "E", _ICF, 28, "IAB SIMID 1.0 §3.1")),
        plant({28: '<InteractiveCreativeFile mediaFileId="m1" type="text/html" apiFramework="SIMID"><![CDATA[ftp://ads.example.com/x]]></InteractiveCreativeFile>'}, ("SIMID-1.0-simid-url-https", "E", _ICF, 28, "IAB SIMID 1.0 §3.1")),
        plant({28: '<InteractiveCreativeFile mediaFileId="m1" type="text/html" apiFramework="SIMID"><![CDATA[data:text/html, ]]></InteractiveCreativeFile>'}, ("VAST-2.0-ctv-interactive-payload", "E", _ICF, 28, JULY)),
        plant({28: '<InteractiveCreativeFile mediaFileId="m1" type="text/html" apiFramework="SIMID"><HTMLResource><![CDATA[<p/>]]></HTMLResource><AdParameters xmlEncoded="maybe">p</AdParameters></InteractiveCreativeFile>'},
              ("VAST-3.0-adparameters-xmlencoded-value", "W", f"{_ICF}/AdParameters[@xmlEncoded]", 28, "IAB VAST 3.0 §2.3.5.3", 126)),
        plant({28: '<InteractiveCreativeFile mediaFileId="m1" type="text/html" apiFramework="SIMID"><HTMLResource a="1">p</HTMLResource></InteractiveCreativeFile>'},
              ("VAST-2.0-ctv-interactive-payload", "E", _ICF, 28, JULY), ("VAST-2.0-unknown-attribute", "W", f"{_ICF}/HTMLResource[@a]", 28, "IAB VAST 2.0 §2", 81)),
        plant({15: f'<MediaFile id="m1" delivery="progressive" type="image/png" width="640" height="360">{_URL}</MediaFile>'},
              ("SIMID-1.0-simid-mediafile-required", "E", _ICF, 28, "IAB SIMID 1.0 §3.4"), ("VAST-2.0-mediafile-image", "W", f"{INLINE}/Creatives/Creative[0]/Linear/MediaFiles/MediaFile[0]", 15, "IAB VAST 2.0 §2.3.5.2")),
        plant({31: '<Icon program="AdChoices" width="10" height="10" xPosition="left" yPosition="top" regs="2">'}, ("VAST-2.0-ctv-icon-regs", "E", _ICON, 31, JULY)),
        plant({31: '<Icon program="AdChoices" height="10" xPosition="left" yPosition="top" size="3">'},
              ("VAST-3.0-icon-width", "E", _ICON, 31, "IAB VAST 3.0 §2.3.6.4"), ("VAST-3.0-icon-attrs", "W", _ICON, 31, "IAB VAST 3.0 §2.4.2"), ("VAST-2.0-unknown-attribute", "W", f"{_ICON}[@size]", 31, "IAB VAST 2.0 §2")),
        plant({32: "<Odd/>"}, ("VAST-3.0-icon-resource", "E", _ICON, 31, "IAB VAST 3.0 §2.3.6.4"), ("VAST-3.0-icon-unknown-child", "E", f"{_ICON}/Odd", 32, "IAB VAST 3.0 §2.3.6.4")),
        plant({32: "<StaticResource>" + _URL + "</StaticResource><IconClicks/><IconClicks/>"}, ("VAST-2.0-duplicate-singular-element", "E", f"{_ICON}/IconClicks", 31, "IAB VAST 4.2 XSD")),
        plant({37: "<Verification>"}, ("VAST-4.1-verification-vendor", "E", f"{_VERIFY}/Verification[0]", 37, "IAB VAST 4.1 §3.17")),
        plant({39: "<Odd/>"}, ("VAST-4.1-verification-parameters", "W", f"{_VERIFY}/Verification[0]", 37, "IAB VAST 4.3 §3.17.5"), ("VAST-4.0-verification-unknown-child", "E", f"{_VERIFY}/Verification[0]/Odd", 39, "IAB VAST 4.2 XSD")),
        plant({38: f'<JavaScriptResource browserOptional="true">{_URL}</JavaScriptResource>'}, ("VAST-4.1-js-resource-apiframework", "E", f"{_VERIFY}/Verification[0]/JavaScriptResource[0]", 38, "IAB VAST 4.1 §3.17.1")),
    ),
)

SPEC_P = "IAB CTV Ad Portfolio for VAST 2.0"
_PX = f"{INLINE}/Extensions/Extension[0]"
_QR = f"{_PX}/CreativeExtensions/CreativeExtension[0]"
_TABLE = "IAB CTV Ad Portfolio §Format-to-Signal Reference Table"
_INTEGER = ("VAST-4.4-adcom-signal-not-integer", "E")
_FILE = f'<MediaFile delivery="progressive" type="video/mp4" width="1" height="1">{_URL}</MediaFile>'
PORTFOLIO = Sheet(
    "ctv_portfolio",
    f"""
<VAST version="2.0">
<Ad id="a{{k}}">
<InLine>
<AdSystem version="1">acme</AdSystem>
<AdTitle>Spring sale {{k}}</AdTitle>
<Impression><![CDATA[https://ads.example.com/i/{{k}}]]></Impression>
<Creatives>
<Creative id="c1">
<NonLinearAds>
<NonLinear width="10" height="10">
<StaticResource creativeType="image/png">{_URL}</StaticResource>
</NonLinear>
</NonLinearAds>
</Creative>
<Creative id="c2">
<Linear>
<Duration>00:00:30</Duration>
<TrackingEvents>
<Tracking event="start">{_URL}</Tracking>
</TrackingEvents>
<MediaFiles>
{_FILE}
</MediaFiles>
</Linear>
</Creative>
</Creatives>
<Extensions>
<Extension type="ctv_ad_portfolio">
<CreativeId>c2</CreativeId>
<plcmt>5</plcmt>
<pos>7</pos>
<playbackmethod>8</playbackmethod>
<attr>19</attr>
<Duration>00:00:15</Duration>
<MediaFiles>
{_FILE}
</MediaFiles>
<CreativeExtensions>
<CreativeExtension type="tl_qrcode">
<QrCodePosition xPosition="10%" yPosition="2.5%"/>
<QrCodeSize size="5%"/>
<QrCodeScanUrl>{_URL}</QrCodeScanUrl>
<QrCodeImageUrl>{_URL}</QrCodeImageUrl>
</CreativeExtension>
</CreativeExtensions>
</Extension>
</Extensions>
</InLine>
</Ad>
</VAST>
""",
    (
        plant({29: "<!-- none -->"}, ("VAST-2.0-ctv-portfolio-creative-id-required", "E", f"{_PX}/CreativeId", 28, f"{SPEC_P} §Implementation")),
        plant({29: "<CreativeId> c7 </CreativeId>"}, ("VAST-2.0-ctv-portfolio-creative-id-unmatched", "E", f"{_PX}/CreativeId", 29, f"{SPEC_P} §Implementation")),
        plant({29: "<CreativeId>c1</CreativeId>"}),
        plant({35: "<!--", 37: "-->"}, ("VAST-2.0-ctv-portfolio-mediafiles-required", "E", f"{_PX}/MediaFiles", 28, f"{SPEC_P} §Media file delivery")),
        plant({29: "<CreativeId>c1</CreativeId>", 35: "<!--", 37: "-->"}),
        plant({36: "<!-- none -->"}, ("VAST-2.0-ctv-portfolio-mediafiles-empty", "E", f"{_PX}/MediaFiles", 35, f"{SPEC_P} §Media file delivery")),
        plant({36: f'<InteractiveCreativeFile apiFramework="SIMID" type="text/html">{_URL}</InteractiveCreativeFile>'}, ("VAST-2.0-ctv-portfolio-no-renderable-asset", "W", f"{_PX}/MediaFiles", 35, f"{SPEC_P} §SIMID interactive creative delivery")),
        plant({34: "<!-- none -->"}, ("VAST-2.0-ctv-portfolio-no-duration", "W", _PX, 28, f"{SPEC_P} §Duration and tracking")),
        plant({30: "<plcmt>five</plcmt>"}, (*_INTEGER, f"{_PX}/plcmt", 30, "IAB AdCOM 1.0 enumerated lists")),
        plant({30: "<plcmt>10</plcmt>"}, ("VAST-4.4-adcom-plcmt-value", "W", f"{_PX}/plcmt", 30, "IAB AdCOM List: Plcmt Subtypes - Video")),
        plant({31: "<pos>18</pos>"}, ("VAST-4.4-adcom-pos-value", "W", f"{_PX}/pos", 31, "IAB AdCOM List: Placement Positions")),
        plant({31: "<pos>12</pos>"}, ("VAST-4.4-adcom-pos-format-mismatch", "W", f"{_PX}/pos", 31, _TABLE)),
        plant({31: "<pos>7</pos><pos>12</pos>"}),
        plant({31: "<pos>x</pos><pos>12</pos>"}, (*_INTEGER, f"{_PX}/pos", 31, "IAB AdCOM 1.0 enumerated lists"), ("VAST-4.4-adcom-pos-format-mismatch", "W", f"{_PX}/pos", 31, _TABLE, 13)),
        plant({31: "<pos>0</pos>"}),
        plant({32: "<playbackmethod>12</playbackmethod>"}, ("VAST-4.4-adcom-playbackmethod-value", "W", f"{_PX}/playbackmethod", 32, "IAB AdCOM List: Playback Methods")),
        plant({32: "<playbackmethod>1</playbackmethod>"}, ("VAST-4.4-adcom-playbackmethod-format-mismatch", "W", f"{_PX}/playbackmethod", 32, _TABLE)),
        plant({30: "<plcmt>9</plcmt>"}, ("VAST-4.4-adcom-playbackmethod-format-mismatch", "W", f"{_PX}/playbackmethod", 32, _TABLE)),
        plant({33: "<attr>18</attr>"}, ("VAST-4.4-adcom-attr-not-motion", "I", f"{_PX}/attr", 33, "IAB CTV Ad Portfolio §Declaring Creative Experience with battr and attr")),
        plant({40: '<QrCodePosition xPosition="10"/>'}, ("VAST-4.4-qrcode-position-percent", "E", f"{_QR}/QrCodePosition@xPosition", 40, "IAB vast_4.4.xsd vastPercent_type"), ("VAST-4.4-qrcode-position-attrs", "E", f"{_QR}/QrCodePosition@yPosition", 40, "IAB vast_4.4.xsd vastQrCodePosition_type")),
        plant({41: "<QrCodeSize/>"}, ("VAST-4.4-qrcode-size-attr", "E", f"{_QR}/QrCodeSize", 41, "IAB vast_4.4.xsd vastQrCodeSize_type")),
        plant({41: '<QrCodeSize size="5.%"/>'}, ("VAST-4.4-qrcode-size-percent", "E", f"{_QR}/QrCodeSize@size", 41, "IAB vast_4.4.xsd vastPercent_type")),
        plant({42: "<!-- none -->"}, ("VAST-4.4-qrcode-missing-scan-url", "W", _QR, 39, "IAB CTV Ad Portfolio §QR Code Signaling")),
        plant({43: "<!-- none -->"}, ("VAST-4.4-qrcode-missing-image-url", "W", _QR, 39, "IAB CTV Ad Portfolio §QR Code Signaling")),
        # without any of the first three an extension is no QR code
        plant({40: "<!--", 42: "-->"}),
    ),
)

_NL = f"{INLINE}/Creatives/Creative[0]/NonLinearAds/NonLinear[0]"
_ICF_TAG = f'<InteractiveCreativeFile apiFramework="SIMID" type="text/html">{_URL}</InteractiveCreativeFile>'
SIGNALS = Sheet(
    "ctv_signals",
    f"""
<VAST version="4.2">
<Ad id="a{{k}}">
<InLine>
<AdSystem version="1">acme</AdSystem>
<AdTitle>Spring sale {{k}}</AdTitle>
<AdServingId>s{{k}}</AdServingId>
<Impression><![CDATA[https://ads.example.com/i/{{k}}]]></Impression>
<Creatives>
<Creative id="c1">
<UniversalAdId idRegistry="ad-id.org">A{{k}}</UniversalAdId>
<NonLinearAds>
<NonLinear width="10" height="10">
<Duration>00:00:15</Duration>
<MediaFiles>
{_FILE}
</MediaFiles>
</NonLinear>
</NonLinearAds>
</Creative>
</Creatives>
<Extensions>
<Extension type="plcmt" ext="adcom">
<plcmt>7</plcmt>
</Extension>
<Extension type="pos" ext="AdCOM">
<pos>9</pos>
</Extension>
<Extension type="playbackmethod">
<playbackmethod>1</playbackmethod>
</Extension>
</Extensions>
</InLine>
</Ad>
</VAST>
""",
    (
        plant({1: '<VAST version="4.4">'}, ("VAST-4.4-version-attribute", "I", "/VAST@version", 1, "IAB vast_4.4.xsd (draft annotation)")),
        plant({15: _ICF_TAG}, ("VAST-4.4-nonlinear-no-renderable-asset", "W", f"{_NL}/MediaFiles", 14, "IAB CTV Ad Portfolio §Secure Interactive Ad Units (Fallback Media)")),
        plant({15: "<!-- none -->"}, ("VAST-4.4-nonlinear-mediafiles-empty", "E", f"{_NL}/MediaFiles", 14, "IAB CTV Ad Portfolio §Signaling the Five Non-Linear CTV Formats")),
        plant({13: f'<IFrameResource apiFramework="SIMID" type="text/html">{_URL}</IFrameResource>', 15: "<!-- none -->"}, ("VAST-4.4-nonlinear-simid-iframe", "I", f"{_NL}/IFrameResource", 13, "IAB CTV Ad Portfolio §Secure Interactive Ad Units")),
        plant({13: "<!-- none -->"}, ("VAST-4.4-nonlinear-video-no-duration", "W", _NL, 12, "IAB CTV Ad Portfolio §Handling Duration")),
        plant({22: '<Extension type="plc" ext="adcom">'}, ("VAST-4.4-adcom-extension-unknown-signal", "W", f"{_X}[0]@type", 22, "IAB CTV Ad Portfolio §Purpose of VAST ext")),
        plant({22: '<Extension type="pos" ext="adcom">'}, ("VAST-4.4-adcom-extension-type-mismatch", "W", f"{_X}[0]/plcmt", 23, "IAB CTV Ad Portfolio §Purpose of VAST ext")),
        plant({26: "<pos>11</pos>"}, ("VAST-4.4-adcom-pos-format-mismatch", "W", f"{_X}[1]/pos", 26, _TABLE)),
        plant({29: "<playbackmethod>8</playbackmethod>"}, ("VAST-4.4-adcom-playbackmethod-format-mismatch", "W", f"{_X}[2]/playbackmethod", 29, _TABLE)),
        plant({29: "<playbackmethod>1.0</playbackmethod>"}, (*_INTEGER, f"{_X}[2]/playbackmethod", 29, "IAB AdCOM 1.0 enumerated lists")),
        # below 4.0 the extensions are a vendor's; the pair of NonLinear and its files is unknown there
        plant({1: '<VAST version="3.0">'}, ("VAST-2.0-version-mismatch", "W", "/VAST", None, "IAB VAST 2.0 §2.1"),
              *(("VAST-2.0-nonlinear-unknown-child", "E", f"{_NL.replace('NonLinear[0]', 'NonLinear')}/{kid}", line, "IAB VAST 2.0 §2.3.7") for kid, line in (("Duration", 13), ("MediaFiles", 14)))),
    ),
)
_NONE = "<!-- none -->"
_C0, _C1 = f"{INLINE}/Creatives/Creative[0]", f"{INLINE}/Creatives/Creative[1]"
_L0, _ICON0 = f"{_C0}/Linear", f"{_C0}/Linear/Icons/Icon[0]"
_QUARTILES = ("VAST-2.0-linear-tracking-quartiles", "W", _L0, 14, "IAB VAST 4.1 §3.14.2")
_IMPRESSION = f"{INLINE}/Impression[3]"
_INLINE_TEXT = f"""
<VAST version="4.2">
<Ad id="a{{k}}" adType="video">
<InLine>
<AdSystem version="1">acme</AdSystem>
<AdTitle>Spring sale {{k}}</AdTitle>
<AdServingId>s{{k}}</AdServingId>
<Impression><![CDATA[https://ads.example.com/i/{{k}}]]></Impression>
<Category authority="https://www.iabtechlab.com/categoryauthority">1</Category>
<Pricing model="cpm" currency="USD">1.00</Pricing>
<Expires>3600</Expires>
<Creatives>
<Creative id="c1">
<UniversalAdId idRegistry="ad-id.org">A{{k}}</UniversalAdId>
<Linear skipoffset="00:00:05">
<Duration>00:00:30</Duration>
<AdParameters xmlEncoded="false">p</AdParameters>
<TrackingEvents>
<Tracking event="start">{_URL}</Tracking>
<Tracking event="progress" offset="10%">{_URL}</Tracking>
</TrackingEvents>
<MediaFiles>
<Mezzanine delivery="progressive" type="video/mp4" width="1" height="1">{_URL}</Mezzanine>
{_FILE}
</MediaFiles>
<Icons>
<Icon program="p" width="1" height="1" xPosition="left" yPosition="top">
<StaticResource creativeType="image/png">{_URL}</StaticResource>
<IconClicks>
<IconClickFallbackImages>
<IconClickFallbackImage width="1" height="1"/>
</IconClickFallbackImages>
</IconClicks>
</Icon>
</Icons>
</Linear>
</Creative>
<Creative id="c2">
<UniversalAdId idRegistry="ad-id.org">B{{k}}</UniversalAdId>
<CompanionAds required="any">
<Companion width="1" height="1" renderingMode="default">
<StaticResource creativeType="image/png">{_URL}</StaticResource>
<CompanionClickTracking id="t">{_URL}</CompanionClickTracking>
</Companion>
</CompanionAds>
<NonLinearAds>
<NonLinear width="1" height="1">
<StaticResource creativeType="image/png">{_URL}</StaticResource>
</NonLinear>
</NonLinearAds>
</Creative>
</Creatives>
</InLine>
</Ad>
</VAST>
"""
INLINES = Sheet(
    "inline",
    _INLINE_TEXT,
    (
        plant({4: _NONE}, ("VAST-2.0-inline-adsystem", "E", INLINE, 3, "IAB VAST 2.0 §2.3.1")),
        plant({5: _NONE}, ("VAST-2.0-inline-adtitle", "E", INLINE, 3, "IAB VAST 2.0 §2.3.2")),
        plant({6: _NONE}, ("VAST-4.1-adservingid-present", "E", INLINE, 3, "IAB VAST 4.1 §3.4.1")),
        plant({7: _NONE}, ("VAST-2.0-inline-impression", "E", INLINE, 3, "IAB VAST 2.0 §2.3.4")),
        plant({11: "<!--", 51: "-->"}, ("VAST-2.0-inline-creatives", "E", INLINE, 3, "IAB VAST 2.0 §2.3.5")),
        plant({12: "<!--", 50: "-->"}, ("VAST-2.0-inline-creatives", "E", f"{INLINE}/Creatives", 3, "IAB VAST 2.0 §2.3.5")),
        plant({2: '<Ad id="b"/><Ad id="a{k}">'}, ("VAST-2.0-ad-has-inline-or-wrapper", "E", "/VAST/Ad[0]", 2, "IAB VAST 2.0 §2.2")),
        plant({2: '<Ad sequence="1"><InLine/><Wrapper/></Ad><Ad id="a{k}">', 3: "<InLine>"},
              ("VAST-2.0-ad-has-inline-or-wrapper", "E", "/VAST/Ad[0]", 2, "IAB VAST 2.0 §2.2"), ("VAST-2.0-ad-sequence", "W", "/VAST", None, "IAB VAST 2.0 §2.2"),
              *((f"VAST-{v}-{r}", "E", f"/VAST/Ad[0]/{c}", 2, spec, col) for v, r, c, spec, col in (
                  ("2.0", "inline-adsystem", "InLine", "IAB VAST 2.0 §2.3.1", 18), ("2.0", "inline-adtitle", "InLine", "IAB VAST 2.0 §2.3.2", 18), ("2.0", "inline-impression", "InLine", "IAB VAST 2.0 §2.3.4", 18),
                  ("2.0", "inline-creatives", "InLine", "IAB VAST 2.0 §2.3.5", 18), ("4.1", "adservingid-present", "InLine", "IAB VAST 4.1 §3.4.1", 18),
                  ("2.0", "wrapper-adsystem", "Wrapper", "IAB VAST 2.0 §2.3.1", 27), ("2.0", "wrapper-impression", "Wrapper", "IAB VAST 2.0 §2.3.4", 27), ("2.0", "wrapper-vastadtaguri", "Wrapper", "IAB VAST 2.0 §2.4", 27)))),
        plant({1: '<VAST version="4.2"><Error/>'}, ("VAST-4.0-wrapper-root-error", "W", "/VAST", 1, "IAB VAST 4.0 §2.1")),
        plant({8: "<Category>1</Category>"}, ("VAST-4.0-category-authority", "E", f"{INLINE}/Category[0]", 8, "IAB VAST 4.0 §2.3.3")),
        plant({8: '<Category authority="no host">1</Category>'}, ("VAST-4.0-category-authority-not-uri", "W", f"{INLINE}/Category[0][@authority]", 8, "IAB VAST 4.0 §2.3.3")),
        plant({8: '<Category authority="https://other.example.com/x">1</Category>'}, ("VAST-4.0-category-authority-unknown", "I", f"{INLINE}/Category[0][@authority]", 8, "IAB Tech Lab Content Taxonomy")),
        plant({9: "<Pricing>1</Pricing>"}, *((f"VAST-3.0-pricing-{x}", "E", f"{INLINE}/Pricing", 9, "IAB VAST 3.0 §2.3.10") for x in ("model", "currency"))),
        plant({9: '<Pricing model="CPM" currency="USDX">1</Pricing>'}, ("VAST-3.0-pricing-currency-format", "W", f"{INLINE}/Pricing[@currency]", 9, "IAB VAST 3.0 §2.3.10")),
        plant({10: "<Expires>soon</Expires>"}, ("VAST-4.1-expires-integer", "W", f"{INLINE}/Expires", 10, "IAB VAST 4.2 XSD")),
        plant({2: '<Ad adType="banner">'}, ("VAST-4.1-adtype-value", "W", "/VAST/Ad[0][@adType]", 2, "IAB VAST 4.1 §2.2.1")),
        plant({2: '<Ad conditionalAd="true">'}, ("VAST-4.0-conditionalad", "W", "/VAST/Ad[0]", 2, "IAB VAST 4.1 §2.2.1")),
        plant({13: _NONE}, ("VAST-4.0-universaladid-present", "E", _C0, 12, "IAB VAST 4.0 §3.8.1")),
        plant({13: "<UniversalAdId>A</UniversalAdId>"}, ("VAST-4.0-universaladid-idregistry", "E", f"{_C0}/UniversalAdId", 12, "IAB VAST 4.0 §3.8.1")),
        plant({13: '<UniversalAdId idRegistry="r" idValue="v"/>'}, ("VAST-4.1-universaladid-idvalue-removed", "W", f"{_C0}/UniversalAdId", 13, "IAB VAST 4.1 §2.3.5.3")),
        plant({13: '<UniversalAdId idRegistry="r"/>'}, ("VAST-4.1-universaladid-content", "E", f"{_C0}/UniversalAdId", 13, "IAB VAST 4.1 §2.3.5.3")),
        plant({15: _NONE}, ("VAST-2.0-linear-duration", "E", _L0, 14, "IAB VAST 2.0 §2.3.5.1")),
        plant({15: "<Duration>30s</Duration>"}, ("VAST-2.0-duration-format", "E", f"{_L0}/Duration", 15, "IAB VAST 2.0 §2.3.5.1")),
        plant({15: "<Duration>00:00:00.500</Duration>"}, ("VAST-2.0-duration-zero", "W", f"{_L0}/Duration", 15, "IAB VAST 2.0 §2.3.5.1")),
        plant({21: "<!--", 24: "-->"}, ("VAST-2.0-linear-mediafiles", "E", _L0, 14, "IAB VAST 2.0 §2.3.5.2")),
        plant({22: _NONE, 23: _NONE}, ("VAST-2.0-linear-mediafiles", "E", f"{_L0}/MediaFiles", 14, "IAB VAST 2.0 §2.3.5.2"), ("VAST-4.1-mezzanine-recommended", "I", f"{_L0}/MediaFiles", 21, "IAB VAST 4.1 §3.9.2")),
        plant({22: f"<Mezzanine>{_URL}</Mezzanine>"}, *((f"VAST-4.1-mezzanine-{a}", "E", f"{_L0}/MediaFiles/Mezzanine[0]", 22, "IAB VAST 4.1 §2.3.5.2") for a in ("delivery", "type", "width", "height"))),
        plant({23: f"<MediaFile>{_URL}</MediaFile>"}, *((f"VAST-2.0-mediafile-{a}", "E", f"{_L0}/MediaFiles/MediaFile[0]", 23, "IAB VAST 2.0 §2.3.5.2") for a in ("delivery", "type", "dimensions", "dimensions"))),
        plant({23: f'<MediaFile delivery="x" type="video/mp4" width="1" height="1" minBitrate="1" bitrate="2">{_URL}</MediaFile>'},
              ("VAST-2.0-mediafile-delivery-enum", "E", f"{_L0}/MediaFiles/MediaFile[0][@delivery]", 23, "IAB VAST 2.0 §2.3.5.2"),
              *((f"VAST-3.0-{r}", x, f"{_L0}/MediaFiles/MediaFile[0]", 23, "IAB VAST 3.0 §2.3.5.2") for r, x in (("minmaxbitrate-pair", "E"), ("bitrate-conflict", "W")))),
        plant({23: _FILE.replace("<MediaFile", '<MediaFile apiFramework="VPAID"')}, ("VAST-4.1-vpaid-apiframework", "W", f"{_L0}/MediaFiles/MediaFile[0]", 23, "IAB VAST 4.1 §2.3.5.1")),
        plant({23: _FILE.replace("<MediaFile", '<MediaFile apiFramework="other"')}, ("VAST-4.0-mediafile-apiframework", "I", f"{_L0}/MediaFiles/MediaFile[0]", 23, "IAB VAST 4.0 §2.3.5.2")),
        plant({23: _FILE.replace("video/mp4", "application/x-shockwave-flash")}, ("VAST-2.0-flash-mediafile", "W", f"{_L0}/MediaFiles/MediaFile[0]", 23, "IAB VAST 2.0 §2.3.5.2")),
        plant({14: '<Linear skipoffset="5">'}, ("VAST-3.0-skipoffset-format", "W", f"{_L0}[@skipoffset]", 14, "IAB VAST 3.0 §2.3.6")),
        plant({14: "<Linear>", 18: f'<Tracking event="skip">{_URL}</Tracking>'}, ("VAST-3.0-skip-event-no-skipoffset", "W", f"{_L0}/TrackingEvents", 14, "IAB VAST 3.0 §2.3.6"), _QUARTILES),
        plant({17: "<!--", 20: "-->"}, _QUARTILES),
        plant({19: f'<Tracking event="progress">{_URL}</Tracking>'}, ("VAST-3.0-progress-offset", "E", f"{_L0}/TrackingEvents/Tracking[1]", 19, "IAB VAST 3.0 §2.3.6")),
        plant({19: f'<Tracking event="progress" offset="soon">{_URL}</Tracking>'}, ("VAST-3.0-progress-offset-format", "W", f"{_L0}/TrackingEvents/Tracking[1][@offset]", 19, "IAB VAST 3.0 §2.3.6")),
        plant({18: f'<Tracking event="fullscreen">{_URL}</Tracking>'}, ("VAST-4.0-tracking-event-removed", "W", f"{_L0}/TrackingEvents/Tracking[0][@event]", 18, "IAB VAST 4.0 §2.3.6"), _QUARTILES),
        plant({19: f'<Tracking event="expand">{_URL}</Tracking>'}, ("VAST-4.1-tracking-event-value", "E", f'{_L0}/TrackingEvents/Tracking[1][@event="expand"]', 19, "IAB VAST 4.2 §2.3.6")),
        plant({16: '<AdParameters xmlEncoded="maybe">p</AdParameters>'}, ("VAST-3.0-adparameters-xmlencoded-value", "W", f"{_L0}/AdParameters[@xmlEncoded]", 16, "IAB VAST 3.0 §2.3.5.3")),
        plant({26: "<Icon>"}, *((f"VAST-3.0-icon-{a}", "W", _ICON0, 26, "IAB VAST 4.3 §3.11.1") for a in ("program", "width", "height", "xposition", "yposition")), ("VAST-3.0-icon-attrs", "W", _ICON0, 26, "IAB VAST 3.0 §2.4.2")),
        plant({27: _NONE}, ("VAST-3.0-icon-resource", "E", _ICON0, 26, "IAB VAST 3.0 §2.3.6.4")),
        plant({30: "<IconClickFallbackImage/>"}, ("VAST-4.2-icon-fallback-image-width-height", "W", f"{_ICON0}/IconClicks/IconClickFallbackImages/IconClickFallbackImage[0]", 30, "IAB VAST 4.2 §2.3.6.4")),
        plant({39: '<CompanionAds required="some">'}, ("VAST-3.0-companion-required-attr", "W", f"{_C1}/CompanionAds[@required]", 39, "IAB VAST 3.0 §2.3.8")),
        plant({40: '<Companion renderingMode="x">'}, ("VAST-2.0-companion-dimensions", "W", f"{_C1}/CompanionAds/Companion[0]", 40, "IAB VAST 2.0 §2.3.7.1"), ("VAST-4.1-companion-renderingmode-value", "W", f"{_C1}/CompanionAds/Companion[0][@renderingMode]", 40, "IAB VAST 4.1 §2.3.8")),
        plant({41: _NONE}, ("VAST-2.0-companion-resource", "E", f"{_C1}/CompanionAds/Companion[0]", 40, "IAB VAST 2.0 §2.3.7")),
        plant({42: f"<CompanionClickTracking>{_URL}</CompanionClickTracking>"}, ("VAST-4.0-companion-clicktracking-id", "E", f"{_C1}/CompanionAds/Companion[0]/CompanionClickTracking[0]", 42, "IAB VAST 4.0 §2.3.8")),
        plant({46: "<NonLinear>"}, ("VAST-2.0-nonlinear-dimensions", "W", f"{_C1}/NonLinearAds/NonLinear[0]", 46, "IAB VAST 2.0 §2.3.6.1")),
        plant({47: _NONE}, ("VAST-2.0-nonlinear-resource", "E", f"{_C1}/NonLinearAds/NonLinear[0]", 46, "IAB VAST 2.0 §2.3.6.1")),
        plant({5: "<AdTitle> Test </AdTitle>"}, ("VAST-2.0-adtitle-quality", "W", f"{INLINE}/AdTitle", 5, "IAB VAST 2.0 §2")),
        plant({4: "<AdSystem>unknown</AdSystem>"}, *((f"VAST-2.0-adsystem-{x}", "I", f"{INLINE}/AdSystem", 4, "IAB VAST 2.0 §2") for x in ("quality", "no-version"))),
        plant({6: "<AdServingId/>"}, ("VAST-4.1-ad-serving-id-empty", "W", f"{INLINE}/AdServingId", 6, "IAB VAST 4.1 §3.4.1")),
        plant({10: "<Survey>u</Survey>"}, ("VAST-4.1-survey-deprecated", "W", f"{INLINE}/Survey", 3, "IAB VAST 4.1 §4")),
        plant({7: "<Impression><![CDATA[https://ads.example.com/[CONTENTPLAYHEAD]?a=[ERRORCODE] [REASON]]]></Impression>"},
              ("VAST-4.1-macro-deprecated", "I", _IMPRESSION, 7, "IAB VAST 4.1 §6"), ("VAST-2.0-macro-wrong-context", "I", _IMPRESSION, 7, "IAB VAST 4.2 §6"), ("VAST-2.0-macro-uri-unencoded", "W", _IMPRESSION, 7, "RFC 3986 §2.1")),
        plant({7: "<Impression><![CDATA[https://ads.example.com/[nope]?a=[timestamp]]]></Impression>"}, *((f"VAST-2.0-macro-{x}", "W", _IMPRESSION, 7, "IAB VAST 4.2 §6") for x in ("unknown", "lowercase"))),
        plant({7: "<Impression/>"}, ("VAST-2.0-url-empty", "E", _IMPRESSION, None, "IAB VAST 2.0 §2")),
        plant({7: "<Impression>not a url</Impression>"}, ("VAST-2.0-url-invalid", "W", _IMPRESSION, None, "IAB VAST 2.0 §2")),
        plant({7: "<Impression>http://ads.example.com/{k}</Impression>"}, *((f"VAST-2.0-{x}", "W", _IMPRESSION, 7, "IAB VAST 2.0 §2") for x in ("tracking-https", "url-cdata"))),
        plant({1: '<VAST version="5">'}, ("VAST-2.0-root-version-value", "W", "/VAST[@version]", 1, "IAB VAST 2.0 §2.1")),
        plant({1: "<VAST>"}, ("VAST-2.0-root-version", "E", "/VAST", 1, "IAB VAST 2.0 §2.1")),
    ),
)

CONTENT = Sheet(
    "content",
    _INLINE_TEXT,
    (
        plant({51: "<Odd/></Creatives>"}, ("VAST-2.0-creatives-unknown-child", "E", f"{INLINE}/Creatives/Creative[2]", 51, "IAB VAST 2.0 §2.3.5")),
        plant({36: "<Odd/></Creative>"}, ("VAST-2.0-creative-unknown-child", "E", f"{_C0}/Odd", 36, "IAB VAST 2.0 §2.3.5")),
        plant({35: "<Odd/></Linear>"}, ("VAST-2.0-linear-unknown-child", "E", f"{_L0}/Odd", 35, "IAB VAST 2.0 §2.3.6")),
        plant({20: "<Odd/></TrackingEvents>"}, ("VAST-2.0-trackingevents-unknown-child", "E", f"{_L0}/TrackingEvents/Tracking[2]", 20, "IAB VAST 2.0 §2.3.6")),
        plant({24: "<Odd/></MediaFiles>"}, ("VAST-2.0-mediafiles-unknown-child", "E", f"{_L0}/MediaFiles/Odd", 24, "IAB VAST 2.0 §2.3.5.2")),
        plant({24: "<ClosedCaptionFiles><Odd/></ClosedCaptionFiles></MediaFiles>"}, ("VAST-4.2-closedcaptionfiles-unknown-child", "E", f"{_L0}/MediaFiles/ClosedCaptionFiles/Odd[0]", 24, "IAB VAST 4.2 §2.3.5.2", 21)),
        plant({35: "<VideoClicks><Odd/></VideoClicks></Linear>"}, ("VAST-2.0-videoclicks-unknown-child", "E", f"{_L0}/VideoClicks/Odd", 35, "IAB VAST 2.0 §2.3.6", 14)),
        plant({34: "<Odd/></Icons>"}, ("VAST-3.0-icons-unknown-child", "E", f"{_L0}/Icons/Odd", 34, "IAB VAST 3.0 §2.3.6.4")),
        plant({33: "<Odd/></Icon>"}, ("VAST-3.0-icon-unknown-child", "E", f"{_ICON0}/Odd", 33, "IAB VAST 3.0 §2.3.6.4")),
        plant({32: "<Odd/></IconClicks>"}, ("VAST-3.0-iconclicks-unknown-child", "E", f"{_ICON0}/IconClicks/Odd", 32, "IAB VAST 3.0 §2.3.6.4")),
        plant({44: "<Odd/></CompanionAds>"}, ("VAST-2.0-companionads-unknown-child", "E", f"{_C1}/CompanionAds/Odd", 44, "IAB VAST 2.0 §2.3.8")),
        plant({43: "<Odd/></Companion>"}, ("VAST-2.0-companion-unknown-child", "E", f"{_C1}/CompanionAds/Companion/Odd", 43, "IAB VAST 2.0 §2.3.8")),
        plant({49: "<Odd/></NonLinearAds>"}, ("VAST-2.0-nonlinearads-unknown-child", "E", f"{_C1}/NonLinearAds/Odd", 49, "IAB VAST 2.0 §2.3.7")),
        plant({48: "<Odd/></NonLinear>"}, ("VAST-2.0-nonlinear-unknown-child", "E", f"{_C1}/NonLinearAds/NonLinear/Odd", 48, "IAB VAST 2.0 §2.3.7")),
        plant({52: "<Odd/></InLine>"}, ("VAST-2.0-inline-unknown-child", "E", f"{INLINE}/Odd", 52, "IAB VAST 2.0 §2.3.1")),
        plant({10: "<ViewableImpression><Odd/></ViewableImpression>"}, ("VAST-4.0-viewableimpression-unknown-child", "E", f"{INLINE}/ViewableImpression/Odd", 10, "IAB VAST 4.2 XSD", 21)),
        plant({10: "<AdVerifications><Odd/></AdVerifications>"}, ("VAST-4.0-adverifications-unknown-child", "E", f"{INLINE}/AdVerifications/Odd[0]", 10, "IAB VAST 4.2 XSD", 18)),
        plant({10: "<Extensions><Odd/></Extensions>"}, ("VAST-2.0-extensions-unknown-child", "E", f"{INLINE}/Extensions/Odd[0]", 10, "IAB VAST 3.0 §3.1", 13)),
        plant({36: "<CreativeExtensions><Odd/></CreativeExtensions></Creative>"}, ("VAST-2.0-creativeextensions-unknown-child", "E", f"{_C0}/CreativeExtensions/Odd[0]", 36, "IAB VAST 2.0 §2.3.5", 21)),
        plant({10: "<Extensions><Extension><Vendor><Companion><Icon/></Companion></Vendor></Extension></Extensions>"}, (_MISPLACED, "W", f"{INLINE}/Extensions/Extension[0]/Vendor/Companion", 10, "IAB VAST 2.0 §2", 32)),
        plant({36: "<CreativeExtensions><CreativeExtension><Icon/></CreativeExtension></CreativeExtensions></Creative>"}, ("VAST-2.0-creative-extension-misplaced-element", "W", f"{_C0}/CreativeExtensions/CreativeExtension[0]/Icon", 36, "IAB VAST 2.0 §2", 40)),
        plant({10: "<Extensions><Extension>a &amp; b</Extension></Extensions>"}, ("VAST-2.0-extension-cdata", "W", f"{INLINE}/Extensions/Extension[0]", 10, "W3C XML 1.0 §2.7", 13)),
        plant({36: "<CreativeExtensions><CreativeExtension>a &amp; b</CreativeExtension></CreativeExtensions></Creative>"}, ("VAST-2.0-creative-extension-cdata", "W", f"{_C0}/CreativeExtensions/CreativeExtension[0]", 36, "W3C XML 1.0 §2.7", 21)),
        plant({15: "<Duration>00:00:30<b/></Duration>"}, ("VAST-2.0-text-only-element", "E", f"{_L0}/Duration/b", 15, "IAB VAST 2.0 §2", 19)),
        plant({21: '<MediaFiles x="1" y="2">'}, *(("VAST-2.0-unknown-attribute", "W", f"{_L0}/MediaFiles[@{a}]", 21, "IAB VAST 2.0 §2") for a in "xy")),
        plant({5: '<AdTitle lang="en">Spring</AdTitle>'}, ("VAST-2.0-unknown-attribute", "W", f"{INLINE}/AdTitle[@lang]", 5, "IAB VAST 2.0 §2")),
        plant({35: "<Icons/></Linear>"}, ("VAST-2.0-duplicate-singular-element", "E", f"{_L0}/Icons", 14, "IAB VAST 4.2 XSD")),
        plant({5: "<AdTitle>a</AdTitle><AdTitle>b</AdTitle>", 6: "<AdServingId>a</AdServingId><AdServingId>b</AdServingId>"}, *(("VAST-2.0-duplicate-singular-element", "E", f"{INLINE}/{x}", 3, "IAB VAST 4.2 XSD") for x in ("AdTitle", "AdServingId"))),
    ),
)

WRAPPER = "/VAST/Ad[0]/Wrapper"
_BLOCKED = f"{WRAPPER}/BlockedAdCategories[0]"
WRAPPERS = Sheet(
    "wrapper",
    f"""
<VAST version="4.1">
<Ad id="a{{k}}">
<Wrapper followAdditionalWrappers="true">
<AdSystem version="1">acme</AdSystem>
<Impression><![CDATA[https://ads.example.com/i/{{k}}]]></Impression>
<VASTAdTagURI>{_URL}</VASTAdTagURI>
<BlockedAdCategories authority="iab.com">1</BlockedAdCategories>
<Creatives>
<Creative>
<Linear>
<TrackingEvents>
<Tracking event="start">{_URL}</Tracking>
</TrackingEvents>
<VideoClicks>
<ClickTracking>{_URL}</ClickTracking>
</VideoClicks>
</Linear>
</Creative>
</Creatives>
</Wrapper>
</Ad>
</VAST>
""",
    (
        plant({4: _NONE}, ("VAST-2.0-wrapper-adsystem", "E", WRAPPER, 3, "IAB VAST 2.0 §2.3.1")),
        plant({5: _NONE}, ("VAST-2.0-wrapper-impression", "E", WRAPPER, 3, "IAB VAST 2.0 §2.3.4")),
        plant({6: _NONE}, ("VAST-2.0-wrapper-vastadtaguri", "E", WRAPPER, 3, "IAB VAST 2.0 §2.4")),
        plant({3: '<Wrapper followAdditionalWrappers="yes" allowMultipleAds="TRUE" fallbackOnNoAd="2">'}, *(("VAST-4.0-wrapper-bool-attr", "W", f"{WRAPPER}[@{a}]", 3, "IAB VAST 4.2 XSD") for a in ("followAdditionalWrappers", "fallbackOnNoAd"))),
        plant({7: "<BlockedAdCategories>1</BlockedAdCategories>"}, ("VAST-4.1-blockedadcategories-no-authority", "W", _BLOCKED, 7, "IAB VAST 4.1 §2.3.2")),
        plant({7: '<BlockedAdCategories authority="x y">1</BlockedAdCategories>'}, ("VAST-4.1-blockedadcategories-authority-not-uri", "W", f"{_BLOCKED}[@authority]", 7, "IAB VAST 4.1 §2.3.2")),
        plant({7: '<BlockedAdCategories authority="a.example.com">1</BlockedAdCategories>'}, ("VAST-4.1-blockedadcategories-authority-unknown", "I", f"{_BLOCKED}[@authority]", 7, "IAB Tech Lab Content Taxonomy")),
        plant({15: f"<ClickThrough>{_URL}</ClickThrough>"}, ("VAST-4.0-wrapper-clickthrough", "W", f"{WRAPPER}/Creatives/Creative[0]/Linear/VideoClicks/ClickThrough", 14, "IAB VAST 4.0 §2.4.1")),
        plant({6: "<VASTAdTagURI/>"}, *(("VAST-2.0-url-empty", "E", f"{WRAPPER}/VASTAdTagURI{x}", None, "IAB VAST 2.0 §2") for x in ("", "[2]"))),
        plant({6: "<VASTAdTagURI>http://ads.example.com/{k}</VASTAdTagURI>"}, *(("VAST-2.0-tracking-https", "W", f"{WRAPPER}/VASTAdTagURI{x}", 6, "IAB VAST 2.0 §2") for x in ("", "[2]")), ("VAST-2.0-url-cdata", "W", f"{WRAPPER}/VASTAdTagURI[2]", 6, "IAB VAST 2.0 §2")),
        plant({5: "<Impression>{u}</Impression><Impression>{u}</Impression>".replace("{u}", _URL)}, ("VAST-2.0-duplicate-impression", "W", f"{WRAPPER}/Impression", None, "IAB VAST 2.0 §2.3.3")),
        plant({20: "<Odd/></Wrapper>"}, ("VAST-2.0-wrapper-unknown-child", "E", f"{WRAPPER}/Odd", 20, "IAB VAST 2.0 §2.3.2")),
        plant({1: '<VAST version="3.0">'}),
    ),
)

_V0, _V1 = f"{INLINE}/AdVerifications/Verification[0]", f"{INLINE}/AdVerifications/Verification[1]"
_JS, _EXE = f"{_V0}/JavaScriptResource[0]", f"{_V0}/ExecutableResource[0]"
VERIFICATIONS = Sheet(
    "verification",
    f"""
<VAST version="4.1">
<Ad id="a{{k}}">
<InLine>
<AdSystem version="1">acme</AdSystem>
<AdTitle>Spring sale {{k}}</AdTitle>
<AdServingId>s{{k}}</AdServingId>
<Impression><![CDATA[https://ads.example.com/i/{{k}}]]></Impression>
<Creatives>
<Creative>
<UniversalAdId idRegistry="ad-id.org">A{{k}}</UniversalAdId>
<CompanionAds/>
</Creative>
</Creatives>
<AdVerifications>
<Verification vendor="a.example.com-omid">
<JavaScriptResource apiFramework="omid" browserOptional="true">{_URL}</JavaScriptResource>
<ExecutableResource apiFramework="omid" type="application/x">{_URL}</ExecutableResource>
<VerificationParameters><![CDATA[p]]></VerificationParameters>
<TrackingEvents>
<Tracking event="verificationNotExecuted"><![CDATA[https://ads.example.com/v?r=[REASON]]]></Tracking>
</TrackingEvents>
</Verification>
<Verification vendor="b.example.com-x">
<JavaScriptResource apiFramework="other" browserOptional="true">{_URL}</JavaScriptResource>
</Verification>
</AdVerifications>
</InLine>
</Ad>
</VAST>
""",
    (
        plant({16: _NONE, 17: _NONE}, ("VAST-4.1-verification-no-resource", "W", _V0, 15, "IAB VAST 4.1 §2.4")),
        plant({15: "<Verification>"}, ("VAST-4.1-verification-vendor", "E", _V0, 15, "IAB VAST 4.1 §3.17")),
        plant({15: '<Verification vendor="no vendor">'}, ("VAST-4.1-verification-vendor-format", "W", _V0, 15, "IAB VAST 4.1 §3.17")),
        plant({23: '<Verification vendor=" A.example.com-OMID">'}, ("VAST-4.1-verification-duplicate-vendor", "W", _V1, 23, "IAB VAST 4.1 §3.17"), ("VAST-4.1-verification-parameters", "W", _V1, 23, "IAB VAST 4.3 §3.17.5"), ("VAST-4.1-js-resource-apiframework-value", "W", f"{_V1}/JavaScriptResource[0]", 24, "IAB VAST 4.1 §3.17.1")),
        plant({18: _NONE}, ("VAST-4.1-verification-parameters", "W", _V0, 15, "IAB VAST 4.3 §3.17.5")),
        plant({16: f'<JavaScriptResource browserOptional="true">{_URL}</JavaScriptResource>'}, ("VAST-4.1-js-resource-apiframework", "E", _JS, 16, "IAB VAST 4.1 §3.17.1")),
        plant({16: f'<JavaScriptResource apiFramework="x" browserOptional="true">{_URL}</JavaScriptResource>'}, ("VAST-4.1-js-resource-apiframework-value", "W", _JS, 16, "IAB VAST 4.1 §3.17.1")),
        plant({16: f'<JavaScriptResource apiFramework="omid">{_URL.replace("https:", "http:")}</JavaScriptResource>'}, ("VAST-4.1-js-resource-https", "W", _JS, 16, "IAB VAST 4.1 §3.17.1"), ("VAST-4.3-js-resource-browser-optional", "W", _JS, 16, "IAB VAST 4.3 §3.17.1")),
        plant({17: f"<ExecutableResource>{_URL}</ExecutableResource>"}, ("VAST-4.1-exec-resource-apiframework", "E", _EXE, 17, "IAB VAST 4.1 §3.17.2"), ("VAST-4.1-exec-resource-type", "E", _EXE, 17, "IAB VAST 4.1 §3.17.2")),
        plant({17: f'<ExecutableResource apiFramework="x" type="t">{_URL.replace("https:", "http:")}</ExecutableResource>'}, *((f"VAST-4.1-exec-resource-{x}", "W", _EXE, 17, "IAB VAST 4.1 §3.17.2") for x in ("apiframework-value", "https"))),
        plant({20: f'<Tracking event="verificationNotExecuted">{_URL}</Tracking>'}, ("VAST-4.1-verification-tracking-reason", "W", f"{_V0}/TrackingEvents/Tracking[0]", 20, "IAB VAST 4.3 §3.17.4")),
        plant({20: f'<Tracking event="other">{_URL}</Tracking>'}, ("VAST-4.1-tracking-event-value", "E", f"{_V0}/TrackingEvents/Tracking[0][@event]", 20, "IAB VAST 4.3 §3.17.4")),
        plant({21: "</TrackingEvents><Odd/>"}, ("VAST-4.0-verification-unknown-child", "E", f"{_V0}/Odd", 21, "IAB VAST 4.2 XSD", 18)),
    ),
)

_SIMID_ICF, _SIMID_NL = f"{_L0}/MediaFiles/InteractiveCreativeFile[0]", f"{_C1}/NonLinearAds/NonLinear[0]"
_FRAME = f"{_SIMID_NL}/IFrameResource[0]"

_IFRAME = "SIMID-1.1-iframe-simid"
REPAIRS = Sheet(
    "repairs",
    f"""
<VAST version="4.2">
<Ad id="a{{k}}">
<InLine>
<AdSystem version="1">acme</AdSystem>
<AdTitle>Spring sale {{k}}</AdTitle>
<AdServingId>s{{k}}</AdServingId>
<Impression><![CDATA[https://ads.example.com/i/{{k}}]]></Impression>
<Creatives>
<Creative id="c1">
<UniversalAdId idRegistry="ad-id.org">A{{k}}</UniversalAdId>
<Linear>
<Duration>00:00:15</Duration>
<TrackingEvents>
<Tracking event="start">{_URL}</Tracking>
<Tracking event="interactiveStart">{_URL}</Tracking>
</TrackingEvents>
<MediaFiles>
<Mezzanine delivery="progressive" type="video/mp4" width="1" height="1">{_URL}</Mezzanine>
{_FILE}
{_ICF_TAG}
</MediaFiles>
</Linear>
</Creative>
<Creative id="c2">
<UniversalAdId idRegistry="ad-id.org">B{{k}}</UniversalAdId>
<NonLinearAds>
<NonLinear width="10" height="10" apiFramework="SIMID">
<IFrameResource type="text/html">{_URL}</IFrameResource>
</NonLinear>
</NonLinearAds>
</Creative>
</Creatives>
</InLine>
</Ad>
</VAST>
""",
    tuple(
        Plant(lines, (), repairs)
        for lines, repairs in (
            ({19: _FILE.replace("https:", "http:")}, (("VAST-2.0-mediafile-https", 1),)),
            ({19: _FILE.replace("https:", "HTTP:") + _FILE.replace("https:", "http:")}, (("VAST-2.0-mediafile-https", 2),)),
            ({7: "<Impression>http://ads.example.com/{k}</Impression>", 14: f'<Tracking event="start">{_URL.replace("https:", "http:")}</Tracking>'}, (("VAST-2.0-tracking-https", 2),)),
            ({20: _ICF_TAG.replace("https:", "http:")}, (("SIMID-1.0-simid-url-https", 1),)),
            ({28: f'<IFrameResource type="text/html">{_URL.replace("https:", "http:")}</IFrameResource>'}, ((f"{_IFRAME}-url-https", 1),)),
            ({20: _ICF_TAG.replace('"SIMID"', "' simid '"), 27: '<NonLinear width="10" height="10" apiFramework="Simid">'}, (("SIMID-1.0-simid-apiframework-case", 2),)),
            ({20: _ICF_TAG.replace("type=", 'variableDuration = "Yes" type=')}, (("SIMID-1.0-simid-variable-duration-value", 1),)),
            ({20: _ICF_TAG.replace(' type="text/html"', "")}, (("SIMID-1.0-simid-type-required", 1),)),
            ({28: f"<IFrameResource>{_URL}</IFrameResource><IFrameResource apiFramework='simid' />"}, (("SIMID-1.0-simid-apiframework-case", 1), (f"{_IFRAME}-type-required", 2))),
            # outside of a NonLinear, and of one that isn't meant for SIMID, frames stay without type
            ({27: '<NonLinear width="10" height="10">', 28: f"<IFrameResource>{_URL}</IFrameResource>"}, ()),
            ({2: '<Ad id="a{k}"\t conditionalAd=\'false\'>'}, (("VAST-4.0-conditionalad", 1),)),
            # no parsed URL is hit, so none is told; markup in CDATA sections and comments stays
            ({1: '<VAST version="4.2" xmlns:xsi="http://www.example.com/xsi">'}, ()),
            ({5: '<AdTitle><![CDATA[<x variableDuration="yes" apiFramework="simid">]]></AdTitle><!-- <IFrameResource apiFramework="simid"/> -->'}, ()),
            # with a tag in a place that the parser doesn't count no type is added
            ({5: "<AdTitle>Spring</AdTitle>", 20: _ICF_TAG.replace(' type="text/html"', "") + "</MediaFiles></Linear></Creative></Broken><InteractiveCreativeFile>"}, ()),
        )
    ),
)


_V10, _V11 = "IAB SIMID 1.0 §5", "IAB SIMID 1.1 §3.5.1"
SIMID = Sheet(
    "simid",
    REPAIRS.text,
    (
        plant({20: _ICF_TAG.replace(' type="text/html"', "")}, ("SIMID-1.0-simid-type-required", "E", _SIMID_ICF, 20, _V10), ("VAST-4.1-interactive-creative-type", "W", _SIMID_ICF, 20, "IAB VAST 4.1 §3.9.3")),
        plant({20: '<InteractiveCreativeFile apiFramework="SIMID" type="text/html"/>'}, ("SIMID-1.0-simid-url-empty", "E", _SIMID_ICF, 20, "IAB SIMID 1.0 §3.1")),
        plant({20: _ICF_TAG.replace("https:", "ws:")}, ("SIMID-1.0-simid-url-https", "E", _SIMID_ICF, 20, "IAB SIMID 1.0 §3.1")),
        plant({20: _ICF_TAG.replace(_URL, "<![CDATA[data:text/plain,x]]>")}, ("SIMID-1.0-simid-url-data-html", "E", _SIMID_ICF, 20, "IAB SIMID 1.0 §3.1")),
        plant({20: _ICF_TAG.replace('"SIMID"', '"simid"')}, ("SIMID-1.0-simid-apiframework-case", "W", _SIMID_ICF, 20, _V10)),
        plant({20: _ICF_TAG.replace("type=", 'variableDuration="yes" type=')}, ("SIMID-1.0-simid-variable-duration-value", "W", _SIMID_ICF, 20, _V10)),
        plant({20: _ICF_TAG.replace(' apiFramework="SIMID"', "")}, ("VAST-4.0-interactive-creative-no-api", "W", _SIMID_ICF, 20, "IAB VAST 4.0 §2.3.5.4")),
        plant({19: _FILE.replace("video/mp4", "text/x")}, ("SIMID-1.0-simid-mediafile-required", "E", _L0, 11, "IAB SIMID 1.0 §3.4")),
        plant({19: _FILE.replace("progressive", "streaming")}, ("SIMID-1.0-simid-ssai-no-client", "I", _L0, 11, "IAB VAST 4.1 §1.1.2")),
        plant({15: _NONE}, ("SIMID-1.0-simid-interactive-start", "I", f"{_L0}/TrackingEvents", 11, "IAB VAST 4.2 interactiveStart")),
        plant({19: _FILE.replace("<MediaFile", '<MediaFile apiFramework="vpaid"')}, ("VAST-4.1-vpaid-in-interactive-context", "W", f"{_L0}/MediaFiles/MediaFile[0]", 19, "IAB VAST 4.1 §2.4.3"), ("VAST-4.1-vpaid-apiframework", "W", f"{_L0}/MediaFiles/MediaFile[0]", 19, "IAB VAST 4.1 §2.3.5.1")),
        plant({27: '<NonLinear width="10" height="10" apiFramework="simid">'}, ("SIMID-1.0-simid-apiframework-case", "W", _SIMID_NL, 27, _V10)),
        plant({28: f"<HTMLResource>{_URL}</HTMLResource>"}, ("SIMID-1.1-nonlinear-simid-no-iframe", "E", _SIMID_NL, 27, _V11)),
        plant({28: f"<IFrameResource>{_URL}</IFrameResource>"}, ("SIMID-1.1-iframe-simid-type-required", "W", _FRAME, 28, _V11)),
        plant({28: '<IFrameResource type="text/html"/>'}, ("SIMID-1.1-iframe-simid-url-empty", "E", _FRAME, 28, _V11)),
        plant({28: '<IFrameResource type="text/html"><![CDATA[javascript:x]]></IFrameResource>'}, ("SIMID-1.1-iframe-simid-url-https", "E", _FRAME, 28, _V11)),
        plant({28: '<IFrameResource type="text/html"><![CDATA[data:image/png,x]]></IFrameResource>'}, ("SIMID-1.0-simid-url-data-html", "E", _FRAME, 28, "IAB SIMID 1.0 §3.1")),
    ),
)

_BREAK = "/VMAP/AdBreak[0]"
_V = "IAB VMAP 1.0.1"
_EMBEDDED = "/VMAP/AdBreak[1]/AdSource/VASTAdData"
PLAYLIST = Sheet(
    "playlist",
    """
<vmap:VMAP xmlns:vmap="http://www.iab.net/videosuite/vmap" version="1.0">
<vmap:AdBreak timeOffset="00:00:10" breakType="linear,display" repeatAfter="00:05:00">
<vmap:AdSource id="{k}" allowMultipleAds="true" followRedirects="false">
<vmap:AdTagURI><![CDATA[https://ads.example.com/t]]></vmap:AdTagURI>
</vmap:AdSource>
<vmap:TrackingEvents>
<vmap:Tracking event="breakStart">https://ads.example.com/b</vmap:Tracking>
<vmap:Tracking event="error">https://ads.example.com/e?c=[ERROR_CODE]</vmap:Tracking>
</vmap:TrackingEvents>
</vmap:AdBreak>
<vmap:AdBreak timeOffset="end" breakType="linear">
<vmap:AdSource>
<vmap:VASTAdData>
<VAST version="3.0">
</VAST>
</vmap:VASTAdData>
</vmap:AdSource>
</vmap:AdBreak>
</vmap:VMAP>
""",
    (
        plant({1: '<vmap:VMAP xmlns:vmap="http://www.iab.net/videosuite/vmap">'}, ("VMAP-1.0-root-version", "E", "/VMAP", 1, f"{_V} §2.3")),
        plant({1: '<vmap:VMAP xmlns:vmap="http://www.iab.net/videosuite/vmap" version="2">'}, ("VMAP-1.0-root-version-value", "W", "/VMAP[@version]", 1, f"{_V} §2.3")),
        plant({1: '<vmap:VMAP xmlns:vmap="http://www.example.com" version="1.0">'}, ("VMAP-1.0-root-namespace", "W", "/VMAP", 1, f"{_V} §2.2")),
        plant({19: "<Odd/></vmap:VMAP>"}, ("VMAP-1.0-root-unknown-child", "E", "/VMAP/Odd", 19, f"{_V} §2.3.1")),
        plant({2: "<vmap:AdBreak>"}, *((f"VMAP-1.0-adbreak-{x}", "E", _BREAK, 2, f"{_V} §2.3.1") for x in ("timeoffset", "breaktype"))),
        plant({2: '<vmap:AdBreak timeOffset="soon" breakType="linear, display" repeatAfter="5m">'}, *((f"VMAP-1.0-adbreak-{x.lower()}-{y}", lev, f"{_BREAK}[@{x}]", 2, f"{_V} §2.3.1") for x, y, lev in (("timeOffset", "format", "E"), ("breakType", "value", "E"), ("repeatAfter", "format", "W")))),
        plant({2: '<vmap:AdBreak timeOffset="#2" breakType="linear">'}),
        plant({2: '<vmap:AdBreak timeOffset="start" breakType="linear" repeatAfter="00:05:00">'}, ("VMAP-1.0-repeatafter-conflict", "W", f"{_BREAK}[@repeatAfter]", 2, f"{_V} §2.3.1")),
        plant({10: "<Odd/></vmap:AdBreak>"}, ("VMAP-1.0-adbreak-unknown-child", "E", f"{_BREAK}/Odd", 10, f"{_V} §2.3.1")),
        plant({10: "<vmap:AdSource/></vmap:AdBreak>"}, ("VMAP-1.0-adbreak-multiple-adsource", "E", f"{_BREAK}/AdSource[1]", 10, f"{_V} §2.3.2")),
        plant({3: '<vmap:AdSource allowMultipleAds="1" followRedirects="yes">'}, *(("VMAP-1.0-adsource-bool-attr", "W", f"{_BREAK}/AdSource[@{a}]", 3, f"{_V} §2.3.2") for a in ("allowMultipleAds", "followRedirects"))),
        plant({4: _NONE}, ("VMAP-1.0-adsource-content", "E", f"{_BREAK}/AdSource", 3, f"{_V} §2.3.2")),
        plant({4: "<vmap:AdTagURI/>"}, ("VMAP-1.0-adtaguri-empty", "E", f"{_BREAK}/AdSource/AdTagURI", 4, f"{_V} §2.3.2")),
        plant({4: "<vmap:AdTagURI>https://ads.example.com/t</vmap:AdTagURI>"}, ("VMAP-1.0-adtaguri-cdata", "E", f"{_BREAK}/AdSource/AdTagURI", 4, f"{_V} §2.3.2")),
        plant({4: "<vmap:CustomAdData>x</vmap:CustomAdData>"}, ("VMAP-1.0-customaddata-cdata", "E", f"{_BREAK}/AdSource/CustomAdData", 4, f"{_V} §2.3.2")),
        plant({4: "<vmap:VASTAdData/>"}, ("VMAP-1.0-vastaddata-vast-root", "E", f"{_BREAK}/AdSource/VASTAdData", 4, f"{_V} §2.3.2")),
        plant({14: '<VAST version="2.0">'}, ("VMAP-1.0-embedded-vast-version", "I", f"{_EMBEDDED}/VAST[@version]", 14, f"{_V} §3.2")),
        plant({14: '<VAST version="3.0"><Ad><Wrapper/></Ad>'}, *((f"VAST-2.0-wrapper-{x}", "E", f"{_EMBEDDED}/VAST/Ad[0]/Wrapper", 14, spec, 25) for x, spec in (("adsystem", "IAB VAST 2.0 §2.3.1"), ("impression", "IAB VAST 2.0 §2.3.4"), ("vastadtaguri", "IAB VAST 2.0 §2.4")))),
        plant({11: '<vmap:AdBreak timeOffset="end" breakType="nonlinear,display">'}, ("VMAP-1.0-display-break-no-companions", "I", _EMBEDDED, 12, f"{_V} §2.3.1")),
        plant({9: "<Odd/></vmap:TrackingEvents>"}, ("VMAP-1.0-trackingevents-unknown-child", "E", f"{_BREAK}/TrackingEvents/Odd", 9, f"{_V} §2.3.3")),
        plant({7: "<vmap:Tracking>https://ads.example.com/b</vmap:Tracking>"}, ("VMAP-1.0-tracking-event", "E", f"{_BREAK}/TrackingEvents/Tracking[0]", 7, f"{_V} §2.3.3")),
        plant({7: '<vmap:Tracking event="start"/>'}, ("VMAP-1.0-tracking-event-value", "E", f"{_BREAK}/TrackingEvents/Tracking[0][@event]", 7, f"{_V} §2.3.3"), ("VMAP-1.0-tracking-url-empty", "E", f"{_BREAK}/TrackingEvents/Tracking[0]", 7, f"{_V} §2.3.3")),
        plant({8: '<vmap:Tracking event="error">https://ads.example.com/e</vmap:Tracking>'}, ("VMAP-1.0-error-tracking-macro", "I", f"{_BREAK}/TrackingEvents/Tracking[1]", 8, f"{_V} §2.5")),
    ),
)

_DIN, _DWR = "/DAAST/Ad[0]/InLine", "/DAAST/Ad[1]/Wrapper"
_DL = f"{_DIN}/Creatives/Creative[0]/Linear"
_DM, _D = f"{_DL}/MediaFiles/MediaFile[0]", "IAB DAAST 1.0"
AUDIO = Sheet(
    "audio",
    """
<DAAST version="1.0">
<Error><![CDATA[https://ads.example.com/e?c=[ERRORCODE]]]></Error>
<Ad id="a{k}">
<InLine>
<AdTitle>Spring {k}</AdTitle>
<Impression>https://ads.example.com/i</Impression>
<Category>1</Category>
<Pricing model="CPO" currency="euro">1</Pricing>
<Creatives>
<Creative>
<Linear>
<Duration>00:00:30</Duration>
<MediaFiles>
<MediaFile id="m" delivery="progressive" type="audio/mp3">https://ads.example.com/m</MediaFile>
</MediaFiles>
<TrackingEvents>
<Tracking event="progress" offset=" 10% ">https://ads.example.com/t</Tracking>
</TrackingEvents>
</Linear>
</Creative>
</Creatives>
</InLine>
</Ad>
<Ad>
<Wrapper>
<Impression>https://ads.example.com/i</Impression>
<DAASTAdTagURI>https://ads.example.com/d</DAASTAdTagURI>
</Wrapper>
</Ad>
</DAAST>
""",
    (
        plant({1: "<DAAST>"}, ("DAAST-1.0-root-version", "E", "/DAAST", 1, f"{_D} §3.1.1")),
        plant({1: '<DAAST version="2.0">'}, ("DAAST-1.0-root-version-value", "W", "/DAAST[@version]", 1, f"{_D} §3.1.1")),
        plant({2: "<!--", 29: "-->"}, ("DAAST-1.0-root-has-ad-or-error", "E", "/DAAST", 1, f"{_D} §3.1.2")),
        plant({2: "<Error> </Error>"}, ("DAAST-1.0-error-url-empty", "W", "/DAAST/Error[0]", 2, f"{_D} §3.1.3")),
        plant({2: "<Error>https://ads.example.com/e</Error>"}, ("DAAST-1.0-error-tracking-macro", "I", "/DAAST/Error[0]", 2, f"{_D} §3.1.3")),
        plant({25: "<!--", 28: "-->"}, ("DAAST-1.0-ad-has-inline-or-wrapper", "E", "/DAAST/Ad[1]", 24, f"{_D} §3.1.2")),
        plant({5: _NONE}, ("DAAST-1.0-inline-adtitle", "E", _DIN, 4, f"{_D} §3.1.4.1")),
        plant({6: _NONE}, ("DAAST-1.0-inline-impression", "E", _DIN, 4, f"{_D} §3.1.4.1")),
        plant({7: _NONE}, ("DAAST-1.0-inline-category", "E", _DIN, 4, f"{_D} §3.1.4.1")),
        plant({9: "<!--", 21: "-->"}, ("DAAST-1.0-inline-creatives", "E", _DIN, 4, f"{_D} §3.1.6")),
        plant({10: "<!--", 20: "-->"}, ("DAAST-1.0-inline-creatives", "E", _DIN, 4, f"{_D} §3.1.6")),
        plant({8: "<Pricing>1</Pricing>"}, *((f"DAAST-1.0-pricing-{x}", "E", f"{_DIN}/Pricing", 8, f"{_D} §3.1.4.2") for x in ("model", "currency"))),
        plant({8: '<Pricing model="flat" currency="EUR">1</Pricing>'}, ("DAAST-1.0-pricing-model-value", "W", f"{_DIN}/Pricing[@model]", 8, f"{_D} §3.1.4.2")),
        plant({12: _NONE}, ("DAAST-1.0-linear-duration", "E", _DL, 11, f"{_D} §3.2.1.2")),
        plant({12: "<Duration>30s</Duration>"}, ("DAAST-1.0-duration-format", "E", f"{_DL}/Duration", 12, f"{_D} §3.2.1.2")),
        plant({13: "<!--", 15: "-->"}, ("DAAST-1.0-linear-mediafiles", "E", _DL, 11, f"{_D} §3.2.1.3")),
        plant({14: _NONE}, ("DAAST-1.0-linear-mediafiles", "E", _DL, 11, f"{_D} §3.2.1.3")),
        plant({14: "<MediaFile/>"}, *((f"DAAST-1.0-mediafile-{x}", lev, _DM, 14, f"{_D} §3.2.1.4") for x, lev in (("delivery", "E"), ("type", "E"), ("id", "W"), ("url-empty", "E")))),
        plant({14: '<MediaFile id="m" delivery="x" type="video/mp4">u</MediaFile>'}, ("DAAST-1.0-mediafile-delivery-enum", "E", f"{_DM}[@delivery]", 14, f"{_D} §3.2.1.4"), ("DAAST-1.0-mediafile-audio-type", "W", f"{_DM}[@type]", 14, f"{_D} §3.2.1.4")),
        plant({17: '<Tracking event="fullscreen">u</Tracking>'}, ("DAAST-1.0-tracking-event-value", "E", f"{_DL}/TrackingEvents/Tracking[0][@event]", 17, f"{_D} §3.2.1.7")),
        plant({17: '<Tracking event="progress">u</Tracking>'}, ("DAAST-1.0-progress-offset", "E", f"{_DL}/TrackingEvents/Tracking[0]", 17, f"{_D} §3.2.4.3")),
        plant({17: '<Tracking event="progress" offset="late">u</Tracking>'}, ("DAAST-1.0-progress-offset", "E", f"{_DL}/TrackingEvents/Tracking[0][@offset]", 17, f"{_D} §3.2.4.3")),
        plant({15: "</MediaFiles><VideoClicks/>"}, ("DAAST-1.0-videoclicks-element", "W", f"{_DL}/VideoClicks", 15, f"{_D} §3.2.1.6", 14)),
        plant({15: "</MediaFiles><AudioInteractions/>"}, ("DAAST-1.0-audiointeractions-renamed", "W", f"{_DL}/AudioInteractions", 15, "IAB DAAST 1.1 Document Updates", 14)),
        plant({26: _NONE}, ("DAAST-1.0-wrapper-impression", "E", _DWR, 25, f"{_D} §3.3.1.1")),
        plant({27: "<VASTAdTagURI>u</VASTAdTagURI>"}, ("DAAST-1.0-wrapper-daastadtaguri", "E", _DWR, 25, f"{_D} §3.3.1.1"), ("DAAST-1.0-wrapper-vast-adtaguri", "W", f"{_DWR}/VASTAdTagURI", 27, f"{_D} §3.3.1.1")),
    ),
)


def repairs_sql(sheet: Sheet) -> str:
    """The repairs of all documents of a sheet, as SQL over the orders' keys."""
    rows = [f"({j}, '{rule}', {n})" for j, p in enumerate(sheet.plants) for rule, n in p.repairs]
    return f"SELECT o_orderkey::VARCHAR AS doc_id, rule_id, n::BIGINT AS n, '/VAST' AS path FROM orders JOIN (VALUES {', '.join(rows)}) AS f(slot, rule_id, n) ON o_orderkey % {sheet.slots} = slot"


SHEETS = {s.name: s for s in (ADDENDUM, PORTFOLIO, SIGNALS, INLINES, CONTENT, WRAPPERS, VERIFICATIONS, SIMID, PLAYLIST, AUDIO)}
