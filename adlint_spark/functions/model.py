"""The content model of ads: fixed tables."""

from __future__ import annotations

# For each parent its children. A tuple: the child holds text only and has these attributes; None: it has children.
MODEL: dict[str, dict[str, tuple[str, ...] | None]] = {
    "InLine": {
        "AdSystem": ("version",), "AdTitle": (), "AdServingId": (), "Description": (), "Advertiser": (), "Pricing": ("model", "currency"), "Impression": ("id",), "Error": (),
        "Survey": ("type",), "Category": ("authority",), "Expires": (), "Creatives": None, "Extensions": None, "AdVerifications": None, "ViewableImpression": None,
    },
    "Wrapper": {
        "AdSystem": ("version",), "VASTAdTagURI": (), "Impression": ("id",), "Error": (), "Pricing": ("model", "currency"), "BlockedAdCategories": ("authority",),
        "Creatives": None, "Extensions": None, "AdVerifications": None, "ViewableImpression": None,
    },
    "Creatives": {"Creative": None},
    "Creative": {"Linear": None, "NonLinearAds": None, "CompanionAds": None, "CreativeExtensions": None, "UniversalAdId": ("idRegistry", "idValue")},
    "Linear": {"Duration": (), "AdParameters": ("xmlEncoded",), "VideoClicks": None, "TrackingEvents": None, "MediaFiles": None, "Icons": None, "Extensions": None},
    "TrackingEvents": {"Tracking": ("event", "offset")},
    "MediaFiles": {
        "MediaFile": ("id", "delivery", "type", "width", "height", "codec", "bitrate", "minBitrate", "maxBitrate", "scalable", "maintainAspectRatio", "apiFramework", "fileSize", "mediaType"),
        "Mezzanine": ("id", "delivery", "type", "width", "height", "codec", "fileSize", "mediaType"),
        "InteractiveCreativeFile": ("type", "apiFramework", "variableDuration"),
        "ClosedCaptionFiles": None,
    },
    "ClosedCaptionFiles": {"ClosedCaptionFile": ("type", "language")},
    "Extensions": {"Extension": None},
    "CreativeExtensions": {"CreativeExtension": None},
    "VideoClicks": {"ClickThrough": ("id",), "ClickTracking": ("id",), "CustomClick": ("id",)},
    "NonLinearAds": {"TrackingEvents": None, "NonLinear": None, "Icons": None},
    "NonLinear": {
        "StaticResource": ("creativeType",), "IFrameResource": ("type", "apiFramework"), "HTMLResource": (), "AdParameters": ("xmlEncoded",), "NonLinearClickThrough": (),
        "NonLinearClickTracking": ("id",), "MediaFiles": None, "Duration": (), "NonLinearCustomClick": ("id",),
    },
    "CompanionAds": {"Companion": None},
    "Companion": {
        "StaticResource": ("creativeType",), "IFrameResource": (), "HTMLResource": (), "AdParameters": ("xmlEncoded",), "AltText": (), "CompanionClickThrough": (),
        "CompanionClickTracking": ("id",), "TrackingEvents": None, "CreativeExtensions": None,
    },
    "Icons": {"Icon": None},
    "Icon": {"StaticResource": ("creativeType",), "IFrameResource": (), "HTMLResource": (), "IconViewTracking": (), "IconClickThrough": (), "IconClickTracking": ("id",), "IconClicks": None},
    "IconClicks": {"IconClickThrough": (), "IconClickTracking": ("id",), "IconClickFallbackImages": None},
    "AdVerifications": {"Verification": None},
    "Verification": {"JavaScriptResource": ("apiFramework", "browserOptional"), "ExecutableResource": ("apiFramework", "type"), "VerificationParameters": (), "TrackingEvents": None},
    "ViewableImpression": {"Viewable": (), "NotViewable": (), "ViewUndetermined": ()},
}
# Attributes of elements with element children; those not named aren't checked.
ATTRIBUTES: dict[str, tuple[str, ...]] = {
    "VAST": ("version",),
    "Ad": ("id", "sequence", "conditionalAd", "adType"),
    "InLine": (),
    "Wrapper": ("followAdditionalWrappers", "allowMultipleAds", "fallbackOnNoAd"),
    "Creatives": (),
    "Creative": ("id", "adId", "AdID", "sequence", "apiFramework"),
    "Linear": ("skipoffset",),
    "MediaFiles": (),
    "ClosedCaptionFiles": (),
    "VideoClicks": (),
    "NonLinearAds": (),
    "NonLinear": ("id", "width", "height", "expandedWidth", "expandedHeight", "scalable", "maintainAspectRatio", "minSuggestedDuration", "apiFramework"),
    "CompanionAds": ("required",),
    "Companion": ("id", "width", "height", "assetWidth", "assetHeight", "expandedWidth", "expandedHeight", "apiFramework", "adSlotId", "pxratio", "renderingMode"),
    "Icons": (),
    "Icon": ("program", "width", "height", "xPosition", "yPosition", "duration", "offset", "apiFramework", "pxratio", "regs"),
    "IconClicks": (),
    "AdVerifications": (),
    "Verification": ("vendor",),
    "ViewableImpression": ("id",),
}
SINCE = {"Icons": "3.0", "Icon": "3.0", "IconClicks": "3.0", "ClosedCaptionFiles": "4.2", "AdVerifications": "4.0", "Verification": "4.0", "ViewableImpression": "4.0"}
# Where each parent's children are told.
TOLD_IN = {
    "InLine": "IAB VAST 2.0 §2.3.1", "Wrapper": "IAB VAST 2.0 §2.3.2", "Creatives": "IAB VAST 2.0 §2.3.5", "Creative": "IAB VAST 2.0 §2.3.5", "Linear": "IAB VAST 2.0 §2.3.6",
    "TrackingEvents": "IAB VAST 2.0 §2.3.6", "MediaFiles": "IAB VAST 2.0 §2.3.5.2", "ClosedCaptionFiles": "IAB VAST 4.2 §2.3.5.2", "Extensions": "IAB VAST 3.0 §3.1",
    "CreativeExtensions": "IAB VAST 2.0 §2.3.5", "VideoClicks": "IAB VAST 2.0 §2.3.6", "NonLinearAds": "IAB VAST 2.0 §2.3.7", "NonLinear": "IAB VAST 2.0 §2.3.7",
    "CompanionAds": "IAB VAST 2.0 §2.3.8", "Companion": "IAB VAST 2.0 §2.3.8", "Icons": "IAB VAST 3.0 §2.3.6.4", "Icon": "IAB VAST 3.0 §2.3.6.4", "IconClicks": "IAB VAST 3.0 §2.3.6.4",
    "AdVerifications": "IAB VAST 4.2 XSD", "Verification": "IAB VAST 4.2 XSD", "ViewableImpression": "IAB VAST 4.2 XSD",
}
#: Allowed from 4.0 on only.
LATE = {"NonLinearAds": ("Icons",), "NonLinear": ("MediaFiles", "Duration", "NonLinearCustomClick")}
#: Parents whose unknown children are named with their place, and those whose only child's name stands for any.
PLACING, RENAMING = ("Extensions", "CreativeExtensions", "AdVerifications", "ClosedCaptionFiles"), ("Creatives", "TrackingEvents")
# Elements that have a place of their own in an ad.
KNOWN = (
    "VAST Ad InLine Wrapper AdSystem AdTitle AdServingId Description Advertiser Pricing Impression Error Survey Expires VASTAdTagURI Category BlockedAdCategories Creatives "
    "Creative UniversalAdId Linear Duration AdParameters VideoClicks ClickThrough ClickTracking CustomClick TrackingEvents Tracking MediaFiles MediaFile Mezzanine "
    "InteractiveCreativeFile ClosedCaptionFiles ClosedCaptionFile NonLinearAds NonLinear NonLinearClickThrough NonLinearClickTracking CompanionAds Companion "
    "CompanionClickThrough CompanionClickTracking StaticResource IFrameResource HTMLResource AltText Icons Icon IconClicks IconClickThrough IconClickTracking "
    "IconViewTracking IconClickFallbackImages AdVerifications Verification JavaScriptResource ExecutableResource VerificationParameters ViewableImpression Viewable "
    "NotViewable ViewUndetermined AdCreativeId"
).split()
