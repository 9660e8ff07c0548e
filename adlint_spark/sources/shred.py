"""The shredder: documents to a table of elements, one row each, in one Arrow pass."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from adlint_spark.functions.model import MODEL
from adlint_spark.functions.values import VERSIONS
from adlint_spark.operators.detect import MACRO_ELEMENTS

MAX_BYTES, MAX_DEPTH, MAX_ELEMENTS = 4 << 20, 128, 100_000
#: Steps of paths of which any sibling counts, not just the first.
INDEXED = frozenset("Ad AdBreak Creative MediaFile Mezzanine InteractiveCreativeFile Icon Tracking Verification Companion NonLinear Extension CreativeExtension".split())
#: Elements outside extensions that tell the least version.
FLOORS = (
    ("4.1", frozenset(["AdServingId"])),
    ("4.0", frozenset(["UniversalAdId", "Verification", "AdVerifications", "InteractiveCreativeFile"])),
    ("3.0", frozenset(["Pricing", "Icons", "ViewableImpression"])),
)
STANDARD_EXTENSIONS = frozenset(["ctv_ad_portfolio", "tl_qrcode"])
CTV_EXTENSIONS = frozenset(["UniversalAdId", "InteractiveCreativeFile", "Mezzanine", "Icon", "AdVerifications"])
#: Children that rules ask of some elements: those with attributes, those with texts. Playlists tell all children.
TOLD_ATTRS = frozenset("Ad Tracking JavaScriptResource ExecutableResource".split())
TOLD_TEXTS = frozenset("Impression VerificationParameters HTMLResource AdParameters".split())
TOLD_UNDER = frozenset("VAST VMAP DAAST InLine Wrapper Verification TrackingEvents AdBreak AdSource InteractiveCreativeFile".split())
ASKING_GRAND = frozenset("Linear NonLinear AdSource".split())
#: Elements of which rules ask more than their own, as facts.
ASKING = frozenset("JavaScriptResource ExecutableResource IFrameResource Verification AdServingId AdSource MediaFile MediaFiles Extension CreativeExtension".split())
_ASKING_MORE = (ASKING - {"MediaFile", "MediaFiles"}) | {"NonLinear"}
_ASKING_MEDIA = frozenset(["InteractiveCreativeFile", "NonLinear", "AdSource"])
_EXTENSIONS = frozenset(["Extension", "CreativeExtension"])
_RESOURCES = frozenset("StaticResource IFrameResource HTMLResource".split())
SIGNALS = ("plcmt", "pos", "playbackmethod", "attr")
#: Where a standardised CTV extension may stand: (element, type) -> trails of what holds it, first and last version's number. Any unknown version fits.
_INLINE, _WRAPPER, _CREATIVE = "VAST/Ad/InLine/Extensions", "VAST/Ad/Wrapper/Extensions", "VAST/Ad/InLine/Creatives/Creative/CreativeExtensions"
CTV_PLACES = {
    ("Extension", "AdVerifications"): ((_INLINE, _WRAPPER), 0, 2),
    ("Extension", "UniversalAdId"): ((_INLINE,), 0, 0),
    ("Extension", "InteractiveCreativeFile"): ((_INLINE,), 0, 0),
    ("Extension", "Mezzanine"): ((_INLINE,), 0, 0),
    ("Extension", "Icon"): ((_INLINE,), 0, 0),
    ("CreativeExtension", "InteractiveCreativeFile"): ((_CREATIVE,), 1, 6),
    ("CreativeExtension", "UniversalAdId"): ((_CREATIVE,), 1, 1),
    ("CreativeExtension", "Mezzanine"): ((_CREATIVE,), 1, 1),
}
#: Payloads that are read like elements of the ad proper: where those stand.
NATIVE = {"Icon": "VAST/Ad/InLine/Creatives/Creative/Linear/Icons/", "AdVerifications": "VAST/Ad/InLine/"}
_BAD_CHARS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_WHOLE = re.compile(r"[+-]?[0-9]+", re.A)
_CDATA = re.compile(rb"<!\[CDATA\[.*?\]\]>", re.S)
#: What a plain document is made of, and tags without anything to decode.
_PIECES = re.compile(r"<!\[CDATA\[.*?\]\]>|<[^>]*>|[^<]+", re.S)
_TAG = re.compile(r"""<([A-Za-z_:][\w:.-]*)((?:[ \n]+[A-Za-z_:][\w:.-]*=(?:"[^"&<\n\t]*"|'[^'&<\n\t]*'))*)[ \n]*(/?)>""", re.A)
#: The commonest: an attribute or two and no prefixes.
_SHORT_TAG = re.compile(r'''<([A-Za-z_][\w.-]*) ([A-Za-z_][\w.-]*)="([^"&<\n\t]*)"(?: ([A-Za-z_][\w.-]*)="([^"&<\n\t]*)")?>''', re.A)
_END_TAG = re.compile(r"</([A-Za-z_:][\w:.-]*)[ \n]*>", re.A)
_ATTRIBUTE = re.compile(r"""([\w:.-]+)=(?:"([^"]*)"|'([^']*)')""", re.A)
_KNOWN_TAGS = 20_000
_PLAIN_CHARS = bytes([9, 10, *range(32, 128)])

_ATTRS = pa.map_(pa.string(), pa.string())
_KID = pa.struct([("name", pa.string()), ("text", pa.string()), ("has_cdata", pa.bool_()), ("line", pa.int32()), ("col", pa.int32()), ("attr", _ATTRS)])
_GRAND = pa.struct([("of", pa.string()), ("name", pa.string()), ("attr", _ATTRS)])
#: Document columns that every element row repeats.
CONTEXT = ("doc_id", "caller", "policy_id", "was_escaped", "forced_version", "wrapper_depth", "max_wrapper_depth", "note")
_CONTEXT_TYPES = {"was_escaped": pa.bool_(), "wrapper_depth": pa.int32(), "max_wrapper_depth": pa.int32()}
NODE_SCHEMA = pa.schema(
    [
        *((c, _CONTEXT_TYPES.get(c, pa.string())) for c in CONTEXT),
        *((c, pa.string()) for c in ("parse_error", "root_name", "root_version", "inferred", "base")), ("ver", pa.int32()),
        *((c, pa.int32()) for c in ("node_id", "parent_id", "depth")),
        ("name", pa.string()), ("pos", pa.int32()), ("name_idx", pa.int32()), ("text", pa.string()), ("has_cdata", pa.bool_()), ("opened", pa.bool_()),
        ("trail", pa.string()), ("spot", pa.string()), ("first", pa.bool_()), ("main", pa.bool_()), ("vendor_ext", pa.bool_()),
        ("line", pa.int32()), ("col", pa.int32()), ("up_line", pa.int32()), ("up_col", pa.int32()), ("bare_attrs", pa.list_(pa.string())), ("odd", pa.bool_()), ("twins", pa.bool_()), ("kid_names", pa.string()),
        ("attr", _ATTRS), ("facts", _ATTRS), ("kids", pa.list_(_KID)), ("grand", pa.list_(_GRAND)),
        ("payload", pa.string()), ("native", pa.string()), ("ctv_from", pa.int32()), ("ctv_to", pa.int32()),
    ]
)
NODE_TYPES = from_arrow_schema(NODE_SCHEMA)
#: Columns of CONTEXT, and places, that elements of one kind have of their own.
_OWN = 3
_MEMBER = pa.struct([*((c, pa.string()) for c in CONTEXT[:_OWN]), *((c, pa.int32()) for c in ("line", "col", "up_line", "up_col"))])
#: Where a member stands: its document's number in the task, higher in each further batch, and its own in the document.
_NUMBERED = pa.struct([*_MEMBER, pa.field("document", pa.int64()), pa.field("node", pa.int32())])
#: Elements that are gathered before they are told apart by kind, and bytes of documents that are like others there.
KIND_ELEMENTS, ALIKE_BYTES = 65_536, 32 << 20
KIND_SCHEMA, NUMBERED_SCHEMA = (NODE_SCHEMA.append(pa.field("members", pa.list_(m))) for m in (_MEMBER, _NUMBERED))
#: Kinds whose members are but their documents' numbers; those of roots are told in full.
COUNTED_SCHEMA = KIND_SCHEMA.append(pa.field("documents", pa.list_(pa.int64())))
KIND_TYPES, NUMBERED_TYPES, COUNTED_TYPES = map(from_arrow_schema, (KIND_SCHEMA, NUMBERED_SCHEMA, COUNTED_SCHEMA))
_FORCED = CONTEXT.index("forced_version")


#: Parents and children that stand together in ads.
PAIRS = [(p, c) for p, kids in MODEL.items() for c in kids] + [("VAST", "Ad"), ("VAST", "Error"), ("Ad", "InLine"), ("Ad", "Wrapper")]


class _Reject(Exception):
    pass


class Tree:
    """Elements in document order, as columns; attributes as flat lists of names and values."""

    def __init__(self):
        self.names, self.parents, self.attrs, self.texts, self.at, self.depth = [], [], [], [], [], []
        self.cdata: set[int] = set()
        self.not_opened: set[int] = set()
        self.error: str | None = None

    def children(self) -> list[list[int]]:
        """The children of each element, gathered in one pass."""
        out: list[list[int]] = [[] for _ in self.names]
        for i, p in enumerate(self.parents):
            if p >= 0:
                out[p].append(i)
        return out


def _tag(piece: str) -> tuple | None:
    """(name, local name, attributes, whether closed at once) of a start tag, (name,) of an end tag; None of anything else, or with something to decode."""
    if piece.startswith("</"):
        end = _END_TAG.fullmatch(piece)
        return end and (end[1],)
    tag = _SHORT_TAG.fullmatch(piece)
    if tag is not None:
        name, one, first, two, second = tag.groups()
        return None if one == two else (name, name, [one, first] if two is None else [one, first, two, second], False)
    tag = _TAG.fullmatch(piece)
    if tag is None:
        return None
    attributes = [x for name, one, two in _ATTRIBUTE.findall(tag[2]) for x in (name, one or two)] if tag[2] else []
    if len(attributes) > 2 and len(set(attributes[::2])) * 2 != len(attributes):
        return None
    return tag[1], tag[1].rpartition(":")[2], attributes, bool(tag[3])


def parse_plain(xml: str, known: dict[str, tuple]) -> tuple[Tree, bytes] | None:
    """The same as ``parse`` of a well-formed ASCII document of tags, CDATA sections and texts without entities; None of all others.

    Tags repeat, so each is taken apart once; ``known`` has those seen before.
    """
    if len(xml) > MAX_BYTES or not xml.isascii() or "\r" in xml:
        return None
    data = xml.encode()
    if data.translate(None, _PLAIN_CHARS):
        return None
    tree = Tree()
    names, parents, attrs, texts, cdata, at, depth, not_opened = tree.names, tree.parents, tree.attrs, tree.texts, tree.cdata, tree.at, tree.depth, tree.not_opened
    place, top, stack, open_names = 0, -1, [], []
    for piece in _PIECES.findall(xml):
        tag = known.get(piece)
        if tag is None and piece[0] != "<":
            chars = piece.strip()
            if chars:
                if top < 0 or "&" in chars or "]]>" in chars:
                    return None
                texts[top] += chars
        elif tag is None and piece.startswith("<![CDATA["):
            if top < 0 or not piece.endswith("]]>"):  # an open section, up to some other end
                return None
            chars = piece[9:-3].strip()
            if chars:
                texts[top] += chars
                cdata.add(top)
        else:
            if tag is None:
                tag = _tag(piece)
                if tag is None:
                    return None
                if len(known) >= _KNOWN_TAGS:
                    known.clear()
                known[piece] = tag
            if len(tag) == 1:
                if top < 0 or open_names.pop() != tag[0]:
                    return None
                top = stack.pop()
            else:
                i = len(names)
                if top < 0 and i:
                    return None  # a second root
                names.append(tag[1])
                parents.append(top)
                attrs.append(tag[2])
                texts.append("")
                at.append(place)
                depth.append(len(stack))
                if tag[3] or tag[0] is not tag[1] and tag[0] != tag[1]:
                    not_opened.add(i)
                if not tag[3]:
                    stack.append(top)
                    open_names.append(tag[0])
                    top = i
        place += len(piece)
    if place != len(xml) or stack or not names or len(names) > MAX_ELEMENTS or max(depth) >= MAX_DEPTH:
        return None
    return tree, data


#: How many bytes of texts are taken apart at once, a document at least.
CHUNK_BYTES = 3 << 20
_CDATA_OPEN = np.frombuffer(b"<![CDATA[", np.uint8)
_IS_PLAIN = np.isin(np.arange(256), np.frombuffer(_PLAIN_CHARS, np.uint8))
#: Elements whose documents are looked at one by one: facts, extensions and grandchildren follow from what is around them.
_LOOKED_AT = _ASKING_MORE - {"AdServingId"} | _ASKING_MEDIA


def _between(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The texts between places, which don't overlap and are in order."""
    borders = np.empty(2 * len(starts), np.int32)
    borders[::2], borders[1::2] = starts, ends
    every = pa.StringArray.from_buffers(max(len(borders) - 1, 0), pa.py_buffer(borders), pa.py_buffer(raw))
    return every.take(pa.array(np.arange(0, len(borders), 2)))


def _blank(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether nothing but white space is between places."""
    out = ends <= starts
    some = np.flatnonzero(~out)
    out[some] = pc.binary_length(pc.utf8_trim_whitespace(_between(raw, starts[some], ends[some]))).to_numpy() == 0
    return out


class _Plain:
    """The elements of those of some documents that ``parse_plain`` takes, and of which no ``_LOOKED_AT`` is one, all at once; ``left`` has the numbers of the others.

    Tags, CDATA sections and texts between them are places in the documents' bytes; levels are a running sum over tags, and start and
    end tags of one level come in turn.
    """

    def __init__(self, column: pa.StringArray, known: dict[str, tuple]):
        count = len(column)
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + count + 1].astype(np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at -= at[0]
        bad = np.zeros(count, bool)
        document = lambda x: np.searchsorted(at, x, side="right") - 1
        bad[(np.diff(at) > MAX_BYTES) | (np.diff(at) == 0)] = True
        bad[document(np.flatnonzero(~_IS_PLAIN[raw]))] = True
        ahead = np.append(raw, np.zeros(len(_CDATA_OPEN), np.uint8))

        # CDATA sections; what begins within one that is open is left to the others
        left, right = np.flatnonzero(raw == 60), np.flatnonzero(raw == 62)
        bad[document(left[ahead[left + 1] == 63])] = True
        opens = left[ahead[left + 1] == 33]
        fits = (ahead[opens[:, None] + np.arange(len(_CDATA_OPEN))] == _CDATA_OPEN).all(axis=1)
        bad[document(opens[~fits])] = True
        opens = opens[fits]
        closers = right[(right > 1) & (ahead[right - 1] == 93) & (ahead[right - 2] == 93)]
        nth = np.searchsorted(closers, opens + 11)
        closes = np.append(closers, len(raw))[nth]
        of = document(opens)
        bad[of[closes >= at[of + 1]]] = True
        bad[of[1:][opens[1:] < closes[:-1]]] = True
        single = np.ones(len(closers) + 1, bool)
        single[nth] = False
        bad[document(closers[single[:-1]])] = True
        opens, closes = (x[~bad[of]] for x in (opens, closes))
        section = np.append(closes, -1)
        inside = lambda x: x <= section[np.searchsorted(opens, x, side="right") - 1]
        amp = np.flatnonzero(raw == 38)
        bad[document(amp[~inside(amp)])] = True

        # tags and sections in order: where each begins and ends
        tags, right = left[~inside(left)], right[~inside(right)]
        starts = np.concatenate([tags, opens])
        order = np.argsort(starts, kind="stable")
        starts = starts[order]
        ends = np.concatenate([np.append(right, len(raw))[np.searchsorted(right, tags)], closes])[order]
        sections = np.concatenate([np.zeros(len(tags), bool), np.ones(len(opens), bool)])[order]
        of = document(starts)
        bad[of[ends >= at[of + 1]]] = True
        bad[of[:-1][ends[:-1] > starts[1:]]] = True

        def keep() -> None:
            nonlocal starts, ends, sections, of
            good = ~bad[of]
            starts, ends, sections, of = starts[good], ends[good], sections[good], of[good]

        keep()
        coded = _between(raw, starts[~sections], ends[~sections] + 1).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        unlike = [known.get(x) or _tag(x) for x in pieces]
        if len(known) + len(unlike) >= _KNOWN_TAGS:
            known.clear()
        known.update((x, t) for x, t in zip(pieces, unlike, strict=True) if t)
        names: dict[str, int] = {}
        kind, full, local = (np.zeros(len(unlike), np.int64) for _ in range(3))
        lists = np.empty(len(unlike), object)
        for i, t in enumerate(unlike):
            kind[i] = 3 if t is None else 1 if len(t) == 1 else 2 if t[3] else 0
            if t:
                full[i] = names.setdefault(t[0], len(names))
                if len(t) > 1:
                    local[i], lists[i] = names.setdefault(t[1], len(names)), t[2]
        code = np.full(len(starts), -1)
        code[~sections] = coded.indices.to_numpy()
        bad[of[np.flatnonzero(~sections)[kind[code[~sections]] == 3]]] = True
        good = ~bad[of]
        code = code[good]
        keep()

        # levels: each document's one root comes first and is closed last
        step = np.where(sections, 0, np.array([1, -1, 0, 0])[kind[code]] if len(kind) else 0)
        new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        total = np.cumsum(step)
        within = np.diff(np.append(new, len(of)))
        after = total - np.repeat(total[new] - step[new], within)
        begins = ~sections & np.isin(kind, (0, 2))[code] if len(kind) else np.zeros(len(of), bool)
        before = after - step
        if len(new):
            lows = np.minimum.reduceat(after, new)
            roots = np.add.reduceat((begins & (before == 0)).astype(np.int64), new)
            outside = np.add.reduceat((sections & (before == 0)).astype(np.int64), new)
            many = np.add.reduceat(begins.astype(np.int64), new)
            deep = np.maximum.reduceat(np.where(begins, before, 0), new)
            last = np.append(new[1:], len(of)) - 1
            blank = _blank(raw, at[of[new]], starts[new]) & _blank(raw, ends[last] + 1, at[of[new] + 1])
            bad[of[new[(lows < 0) | (after[last] != 0) | (roots != 1) | (outside > 0) | (many > MAX_ELEMENTS) | (deep >= MAX_DEPTH) | ~blank]]] = True
        seen = np.zeros(count, bool)
        seen[of] = True
        bad |= ~seen
        good = ~bad[of]
        code, before, after, begins = code[good], before[good], after[good], begins[good]
        keep()
        pairs = np.flatnonzero(~sections & (kind[code] < 2)) if len(kind) else np.zeros(0, np.int64)
        pairs = pairs[np.argsort(of[pairs] * (MAX_DEPTH + 2) + np.minimum(before, after)[pairs], kind="stable")]
        opening, closing = pairs[::2], pairs[1::2]
        bad[of[opening[full[code[opening]] != full[code[closing]]]]] = True

        # elements
        number = np.cumsum(begins) - 1
        element = np.flatnonzero(begins)
        depth, name, owner = before[element], local[code[element]], of[element]
        parent = np.full(len(element), -1)
        above = np.flatnonzero(depth == 0)
        for d in range(1, int(depth.max(initial=0)) + 1):
            rows = np.flatnonzero(depth == d)
            parent[rows] = above[np.searchsorted(above, rows) - 1]
            above = rows
        top = np.full(len(starts), -1)
        top[element] = np.where(kind[code[element]] == 2, parent, np.arange(len(element))) if len(element) else 0
        top[closing] = parent[number[opening]]
        tag = np.maximum.accumulate(np.where(sections, 0, np.arange(len(starts)))) if len(starts) else starts
        top = top[tag]

        # texts: of sections, and behind tags and sections up to the next
        until = np.append(starts[1:], 0)
        final = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
        until[final] = at[of[final] + 1]
        from_, to = np.concatenate([starts[sections] + 9, ends + 1]), np.concatenate([ends[sections] - 2, until])
        whose, literal = np.concatenate([top[sections], top]), np.concatenate([np.ones(int(sections.sum()), bool), np.zeros(len(starts), bool)])
        some = np.flatnonzero(to > from_)
        some = some[np.argsort(from_[some], kind="stable")]
        pieces = pc.utf8_trim_whitespace(_between(raw, from_[some], to[some]))
        filled = pc.binary_length(pieces).to_numpy() > 0
        some, pieces = some[filled], pieces.filter(pa.array(filled))
        whose, literal = whose[some], literal[some]
        by = np.argsort(whose, kind="stable")
        sizes = np.bincount(whose, minlength=len(element))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pieces.take(pa.array(by))), "")
        cdata = np.zeros(len(element), bool)
        cdata[whose[literal]] = True

        # documents that are to be looked at one by one
        self.names = list(names)
        among = lambda some: np.array([x in some for x in self.names], bool)[name]
        holds = lambda rows: np.bincount(owner[rows], minlength=count) > 0
        bad |= holds(among(_LOOKED_AT)) | holds(among({"AdServingId"}) & (sizes == 0)) | holds(among({"VMAP"}) & (depth == 0))
        good = ~bad[owner]
        self.left = np.flatnonzero(bad)
        self.documents = np.flatnonzero(~bad)
        floors = [(v, holds(among(floor))) for v, floor in FLOORS] + [("2.0", holds(among({"MediaFile"})))]
        self.floors = np.select([there[self.documents] for _, there in floors], [np.array(v, object) for v, _ in floors], None).tolist()
        self.name, self.depth, self.cdata = name[good], depth[good], cdata[good]
        self.at = starts[element[good]] - at[owner[good]]
        self.not_opened = ((kind[code[element]] == 2) | (full[code[element]] != name))[good] if len(element) else good
        self.attrs, self.texts = lists[code[element[good]]], texts.filter(pa.array(good))
        self.starts = np.flatnonzero(self.depth == 0)
        moved = np.cumsum(good) - 1
        first = np.repeat(self.starts, np.diff(np.append(self.starts, len(self.depth))))
        self.parents = np.where(parent[good] < 0, -1, moved[parent[good]] - first)
        lines = np.bincount(document(np.flatnonzero(raw == 10)), minlength=count) > 0
        self.lined = []
        for k in np.flatnonzero(lines[self.documents]).tolist():
            d = self.documents[k]
            self.lined.append((k, np.concatenate([[0], np.flatnonzero(raw[at[d] : at[d + 1]] == 10) + 1])))
        self.asking = np.zeros(0, np.int64)
        whole = raw.tobytes()
        if b"skip" in whole or b"&#" in whole:
            asks = pc.or_(pc.match_substring(column, "skip"), pc.match_substring(column, "&#")).to_numpy(zero_copy_only=False)
            self.asking = np.flatnonzero(among(ASKING_GRAND)[good] & asks[owner[good]])


def take_apart(texts: pa.StringArray, known: dict[str, tuple]) -> _Plain:
    """Some plain documents of a few MB in all, at once; ``documents`` has their numbers, ``left`` those of others, which ``parse`` takes."""
    return _Plain(texts, known)


def parse(xml: str) -> tuple[Tree, bytes]:
    """The elements of one document and its bytes. On an error within the document the tree so far is kept."""
    tree, data = Tree(), xml.encode("utf-8", "replace")
    if len(data) > MAX_BYTES:
        tree.error = "document too large"
        return tree, data
    if _BAD_CHARS.search(xml):
        tree.error = "invalid character"
        return tree, data
    parser = expat.ParserCreate("UTF-8")
    parser.ordered_attributes = True
    names, parents, attrs, texts, cdata, at, depth, not_opened = tree.names, tree.parents, tree.attrs, tree.texts, tree.cdata, tree.at, tree.depth, tree.not_opened
    stack, inside = [-1], [False]
    # text around an entity outside CDATA counts as pieces of their own, trimmed one by one
    entities = b"&" in data and b"&" in _CDATA.sub(b"", data)
    held: list[str] = []

    def add(chars: str) -> None:
        chars = chars.strip()
        if chars:
            top = stack[-1]
            texts[top] += chars
            if inside[0]:
                cdata.add(top)

    def flush() -> None:
        if held:
            add("".join(held))
            held.clear()

    def start(name: str, attributes: list[str]) -> None:
        if entities:
            flush()
        i = len(names)
        if i >= MAX_ELEMENTS or len(stack) > MAX_DEPTH:
            raise _Reject("too many elements or levels")
        if ":" in name:
            not_opened.add(i)
            name = name.rpartition(":")[2]
        names.append(name)
        parents.append(stack[-1])
        attrs.append(attributes)
        texts.append("")
        at.append(parser.CurrentByteIndex)
        depth.append(len(stack) - 1)
        stack.append(i)

    def end(_: str) -> None:
        if entities:
            flush()
        i = stack.pop()
        # closed at once: nothing within, and the parser stands behind its tag
        if i == len(names) - 1 and not texts[i] and data.endswith(b"/>", 0, parser.CurrentByteIndex):
            not_opened.add(i)

    def text(chars: str) -> None:
        if not inside[0] and data[parser.CurrentByteIndex] == 38:
            flush()
            add(chars)
        else:
            held.append(chars)

    def border(opens: bool) -> None:
        flush()
        inside[0] = opens

    def reject(*_) -> None:
        raise _Reject("document type declaration")

    def declaration(version: str, *_) -> None:
        if version != "1.0":
            raise _Reject("XML version")

    if not entities:
        parser.buffer_text, parser.buffer_size = True, max(len(data), 1)
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text if entities else add
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: border(True), lambda: border(False)
    parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: flush()
    parser.StartDoctypeDeclHandler, parser.XmlDeclHandler = reject, declaration
    try:
        parser.Parse(data, True)
    except _Reject as e:
        tree.error = str(e)
    except expat.ExpatError as e:
        tree.error = expat.errors.messages.get(e.code, "not well formed")
    if not names:
        tree.error = tree.error or "no element"
    return tree, data


def _value(attributes: list[str], name: str) -> str | None:
    """The first attribute of that local name."""
    for k in range(0, len(attributes), 2):
        if attributes[k] == name or attributes[k].rpartition(":")[2] == name:
            return attributes[k + 1]
    return None


def _standard(tree: Tree, i: int) -> bool:
    return tree.names[i] in _EXTENSIONS and (_value(tree.attrs[i], "type") or "").strip().lower() in STANDARD_EXTENSIONS


def _ctv(tree: Tree, i: int) -> str | None:
    """The type of a standardised CTV extension: its type attribute without prefix, as it stands."""
    if tree.names[i] not in _EXTENSIONS:
        return None
    a = tree.attrs[i]
    kind = next((a[k + 1] for k in range(0, len(a), 2) if a[k] == "type"), None)
    return kind if kind in CTV_EXTENSIONS else None


def _place(tree: Tree, i: int) -> tuple[int, int] | None:
    """The numbers of the first and last version whose CTV extensions of that type stand there; None if none do."""
    kind = _ctv(tree, i)
    where = CTV_PLACES.get((tree.names[i], kind)) if kind else None
    if where is None:
        return None
    steps, k = [], tree.parents[i]
    while k >= 0 and len(steps) < 7:
        steps.append(tree.names[k])
        if tree.names[k] == "VAST" and (tree.parents[k] < 0 or tree.names[tree.parents[k]] == "VASTAdData"):
            break
        k = tree.parents[k]
    return where[1:] if "/".join(reversed(steps)) in where[0] else None


def _number(version: str | None) -> int | None:
    """A declared version's number; None if it isn't a known one."""
    version = (version or "").strip()
    return VERSIONS.index(version) if version in VERSIONS else 0 if version == "2.0.1" else None


def inferred_version(tree: Tree, begin: int, end: int, names: set[str] | None = None) -> str | None:
    """The least version that the elements of a subtree ask for, those in standardised extensions left out."""
    names = set(tree.names[begin:end]) if names is None else names
    told = names
    if not names.isdisjoint(_EXTENSIONS):
        v = _number(_value(tree.attrs[begin], "version"))
        out = [False] * (end - begin)
        for i in range(begin + 1, end):
            held = False
            if tree.names[i] in _EXTENSIONS:
                place = _place(tree, i)
                held = _standard(tree, i) or place is not None and (v is None or place[0] <= v <= place[1])
            out[i - begin] = held or out[tree.parents[i] - begin]
        told = {n for n, x in zip(tree.names[begin:end], out, strict=True) if not x}
    return next((v for v, floor in FLOORS if told & floor), "2.0" if "MediaFile" in names else None)


def effective_version(root: str, forced: str | None, declared: str | None, floor: str | None) -> int | None:
    """The number of the version that rules go by: the forced, else the declared, else the inferred one; none for playlists and audio."""
    if root in ("VMAP", "DAAST"):
        return None
    found = next((n for n in (_number(forced), _number(declared) if root == "VAST" else None, _number(floor)) if n is not None), None)
    return found


def _playable(attributes: list[str]) -> bool:
    kind = _value(attributes, "type") or ""
    return kind.startswith(("video/", "audio/")) or kind == "application/x-mpegURL"


def _whole(text: str) -> int | None:
    """A 64-bit whole number, as it stands between white space."""
    text = text.strip()
    if not _WHOLE.fullmatch(text):
        return None
    n = int(text)
    return n if -(1 << 63) <= n < 1 << 63 else None


class _Facts:
    """What rules ask of an element beyond its own attributes and children. Each list of siblings is read once."""

    def __init__(self, tree: Tree):
        self.tree, self.below = tree, tree.children()
        self.out: dict[int, list[str]] = {}
        self.held: dict = {}

    def once(self, what: str, i: int, make):
        key = (what, i)
        if key not in self.held:
            self.held[key] = make(i)
        return self.held[key]

    def named(self, i: int | None, name: str) -> list[int]:
        return [] if i is None else [k for k in self.below[i] if self.tree.names[k] == name]

    def child(self, i: int | None, name: str) -> int | None:
        return None if i is None else next((k for k in self.below[i] if self.tree.names[k] == name), None)

    def kid_set(self, i: int) -> frozenset[str]:
        return self.once("set", i, lambda p: frozenset(self.tree.names[k] for k in self.below[p]))

    def up(self, i: int, steps: int) -> int:
        for _ in range(steps):
            i = self.tree.parents[i] if i >= 0 else -1
        return i

    def gather(self) -> None:
        tree = self.tree
        for i, (name, p) in enumerate(zip(tree.names, tree.parents, strict=True)):
            if p < 0 or name not in ASKING:
                continue
            told: list[str] = []
            if name == "Verification":
                key = (_value(tree.attrs[i], "vendor") or "").strip().lower()
                seen = self.once("vendors", p, lambda _: set())
                told = ["#again", "1"] if key and key in seen else []
                seen.add(key)
            elif name in ("JavaScriptResource", "ExecutableResource"):
                vendor = _value(tree.attrs[p], "vendor")
                told = ["vendor", vendor] if vendor is not None else []
                told += ["#omid", "1"] if self.once("omid", p, self._omid) else []
            elif name == "IFrameResource":
                api = _value(tree.attrs[p], "apiFramework")
                told = ["apiFramework", api] if api is not None else []
                told += ["#media", "1"] if "MediaFiles" in self.kid_set(p) else []
                told += ["#simid", "1"] if self._meant(p) else []
            elif name == "AdServingId":
                told = ["#creatives", str(self.once("creatives", p, self._filled))] if not tree.texts[i] else []
            elif name == "MediaFile":
                told = ["#icf", "1"] if "InteractiveCreativeFile" in self.kid_set(p) else []
            elif name == "MediaFiles":
                told = ["#classic", "1"] if tree.names[p] == "NonLinear" and self.kid_set(p) & _RESOURCES else []
            elif name == "AdSource":
                kind = _value(tree.attrs[p], "breakType")
                told = ["breakType", kind] if kind is not None else []
                inner = next((v for d in self.named(i, "VASTAdData") for v in self.named(d, "VAST")), None)
                told += ["#companions", "1"] if inner is not None and "CompanionAds" in tree.names[inner : _end(tree, inner)] else []
            else:
                told = self._extension(i, name, p)
            if told:
                self.out.setdefault(i, []).extend(told)

    def _meant(self, i: int) -> bool:
        """Whether the nearest NonLinear at or above an element is meant for SIMID."""
        while i >= 0 and self.tree.names[i] != "NonLinear":
            i = self.tree.parents[i]
        return i >= 0 and (_value(self.tree.attrs[i], "apiFramework") or "").strip().lower() == "simid"

    def _omid(self, p: int) -> bool:
        resources = [k for k in self.below[p] if self.tree.names[k] in ("JavaScriptResource", "ExecutableResource")]
        return any((_value(self.tree.attrs[k], "apiFramework") or "").strip().lower() == "omid" for k in resources)

    def _filled(self, ad: int) -> int:
        """Creatives with media files."""
        return sum(self.child(self.child(c, "Linear"), "MediaFiles") is not None for c in self.named(self.child(ad, "Creatives"), "Creative"))

    # -- standardised extensions

    def _extension(self, i: int, name: str, p: int) -> list[str]:
        tree = self.tree
        kind = _ctv(tree, i)
        told = []
        if kind is not None:
            told = ["#ctv", kind]
            kids = self.below[i]
            if len(kids) == 1 and tree.names[kids[0]] == kind and not tree.texts[i].strip():
                told += ["#shaped", "1"]
                if kind not in ("Icon", "AdVerifications") and _place(tree, i) is not None:
                    self.out.setdefault(kids[0], []).extend(self._bound(i, kids[0], kind))
        holder = self.up(i, 2)
        if name == "Extension" and tree.names[p] == "Extensions" and holder >= 0 and tree.names[holder] in ("InLine", "Wrapper"):
            if (_value(tree.attrs[i], "type") or "").strip().lower() == "ctv_ad_portfolio":
                told += self._portfolio(i, holder)
            elif self._is_signal(i):
                told += ["#adcom", "1"]
                self._signals(p, [k for k in self.below[i] if tree.names[k] in SIGNALS], "adcom", _value(tree.attrs[i], "type"))
        return told

    def _is_signal(self, i: int) -> bool:
        return (_value(self.tree.attrs[i], "ext") or "").lower() == "adcom" or not self.kid_set(i).isdisjoint(SIGNALS)

    def _bound(self, i: int, payload: int, kind: str) -> list[str]:
        """What the payload of an extension is bound to: its own creative, the one element with the id that it names, or the first."""
        tree = self.tree
        legacy = tree.names[i] == "Extension"
        inline = self.child(self.up(i, 3 if legacy else 5), "InLine")
        block = self.child(inline, "Creatives")
        if block is None:
            return ["#bind", "none"]
        creatives = self.once("list", block, lambda b: self.named(b, "Creative"))
        media = lambda c: self.named(self.child(self.child(c, "Linear"), "MediaFiles"), "MediaFile")
        told = ["#creatives", str(len(creatives))]
        if not legacy:
            own = self.up(i, 2)
            nth = self.once("places", self.up(i, 3), lambda b: {c: n for n, c in enumerate(self.named(b, "Creative"))})[own]
            if nth >= len(creatives):
                return ["#bind", "none", *told]
            own = creatives[nth]
            fallback = self.once("playable", own, lambda c: any(_playable(tree.attrs[m]) for m in media(c)))
            return ["#bind", "local", "#target", str(own), *(["#playable", "1"] if fallback and _value(tree.attrs[payload], "mediaFileId") is None else []), *told]
        wanted = _value(tree.attrs[payload], "creativeId" if kind == "UniversalAdId" else "mediaFileId")
        if wanted is not None:
            by_id = self.once("creative ids" if kind == "UniversalAdId" else "media ids", block, lambda _: self._ids(creatives if kind == "UniversalAdId" else [m for c in creatives for m in media(c)]))
            found = by_id.get(wanted, []) if wanted.strip() else []
            if len(found) != 1:
                return ["#bind", "unmatched", *told]
            hit = found[0]
            return ["#bind", "matched", "#target", str(hit), *(["#playable", "1"] if tree.names[hit] == "MediaFile" and _playable(tree.attrs[hit]) else []), *told]
        if not creatives:
            return ["#bind", "none", *told]
        files = self.once("first media", block, lambda _: media(creatives[0])[:1])
        target = files[0] if files and kind != "UniversalAdId" else creatives[0]
        return ["#bind", "first", "#target", str(target), *(["#playable", "1"] if files and _playable(tree.attrs[files[0]]) else []), *told]

    def _ids(self, nodes: list[int]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for k in nodes:
            own = _value(self.tree.attrs[k], "id")
            if own is not None:
                out.setdefault(own, []).append(k)
        return out

    def _signals(self, scope: int, rows: list[int], shape: str, kind: str | None) -> None:
        """Facts of signal elements: the first whole number of each name in a scope counts there."""
        tree = self.tree
        firsts = self.once("firsts", scope, lambda _: {})
        for k in rows:
            told = ["#signal", shape] + (["#type", kind.strip()] if kind is not None else [])
            value = _whole(tree.texts[k])
            if value is not None and tree.names[k] not in firsts:
                firsts[tree.names[k]] = (k, value)
            self.out[k] = told
            self.held.setdefault(("scoped",), []).append((k, scope))

    def finish(self) -> None:
        """Tells the signals that count of the placement that they must agree with, once all of a scope have been read."""
        for k, scope in self.held.get(("scoped",), []):
            firsts = self.held["firsts", scope]
            if firsts.get(self.tree.names[k], (None,))[0] == k and "plcmt" in firsts:
                self.out[k] += ["#plcmt", str(firsts["plcmt"][1])]

    def _portfolio(self, i: int, holder: int) -> list[str]:
        tree = self.tree
        self._signals(i, [k for k in self.below[i] if tree.names[k] in SIGNALS], "portfolio", None)
        block = self.child(holder, "Creatives")
        creatives = [] if block is None else self.once("list", block, lambda b: self.named(b, "Creative"))
        by_id = {} if block is None else self.once("creative ids", block, lambda _: self._ids(creatives))
        named = self.child(i, "CreativeId")
        declared = tree.texts[named].strip() if named is not None else ""
        bound = by_id.get(declared, [None])[0] if declared else creatives[0] if len(creatives) == 1 else None
        native = bound is not None and self.once("native", bound, lambda c: any(self.kid_set(n) & _RESOURCES for n in self.named(self.child(c, "NonLinearAds"), "NonLinear")))
        told = ["#portfolio", "1", "#creatives", str(len(creatives)), "#native", str(int(native))]
        if bound is not None:
            told += ["#target", str(bound)]
        if named is not None:
            told += ["#declared", declared, "#unmatched", str(int(bool(declared and by_id and declared not in by_id)))]
            self.out[named] = ["#unmatched", told[-1]]
        for code in self.named(self.child(i, "CreativeExtensions"), "CreativeExtension"):
            for k in (code, *self.below[code]):
                self.out.setdefault(k, []).extend(["#in_portfolio", "1"])
        files = self.child(i, "MediaFiles")
        if files is not None:
            kids = self.kid_set(files)
            video = any((_value(tree.attrs[m], "type") or "").strip().lower().startswith("video/") for m in self.named(files, "MediaFile"))
            letters = ("m" if "MediaFile" in kids else "") + ("i" if "InteractiveCreativeFile" in kids else "") + ("v" if video else "")
            told += ["#files", letters]
            self.out.setdefault(files, []).extend(["#holds", letters, "#native", str(int(native))])
        return told


def _payloads(tree: Tree) -> dict[int, tuple]:
    """(payload's kind if it has its shape, trail as an element of the ad proper, first and last version) of the elements in CTV extensions in their place."""
    out: dict[int, tuple] = {}
    for i, name in enumerate(tree.names):
        if name in _EXTENSIONS and i not in out:
            place = _place(tree, i)
            if place is None:
                continue
            kind, end = _ctv(tree, i), _end(tree, i)
            kids = [k for k in range(i + 1, end) if tree.parents[k] == i]
            shaped = len(kids) == 1 and tree.names[kids[0]] == kind and not tree.texts[i].strip()
            out[i] = (None, None, *place)
            trails: dict[int, str] = {}
            for k in range(i + 1, end):
                own = None
                if shaped and kind in NATIVE:
                    own = trails[k] = NATIVE[kind] + tree.names[k] if tree.parents[k] == i else f"{trails[tree.parents[k]]}/{tree.names[k]}"
                out[k] = (kind if shaped else None, own, *place)
    return out


def _end(tree: Tree, i: int) -> int:
    """Where the subtree of an element ends."""
    return next((j for j in range(i + 1, len(tree.depth)) if tree.depth[j] <= tree.depth[i]), len(tree.depth))


def _embedded(tree: Tree) -> list[tuple[int, str]]:
    """The VAST elements of a playlist that count as documents, and the paths that they stand below."""
    out, breaks, seen = [], {}, set()
    for i, (name, parent) in enumerate(zip(tree.names, tree.parents, strict=True)):
        if name == "AdBreak" and parent == 0:
            breaks[i] = len(breaks)
        if name in ("AdSource", "VAST") and parent >= 0:
            again = (parent, name) in seen
            seen.add((parent, name))
            if again:
                continue
            seen.add(i)
            if name == "VAST" and tree.names[parent] == "VASTAdData":
                source = tree.parents[parent]
                if source >= 0 and tree.names[source] == "AdSource" and source in seen and tree.parents[source] in breaks:
                    out.append((i, f"/VMAP/AdBreak[{breaks[tree.parents[source]]}]/AdSource/VASTAdData"))
    return out


#: Elements whose texts facts ask for.
_TOLD_BY_TEXT = frozenset(["AdServingId", "CreativeId", "Extension", "CreativeExtension", *SIGNALS])
_KNOWN_SHAPES = 512
#: Elements whose texts are URLs.
_URLS = frozenset(MACRO_ELEMENTS)
#: Elements whose texts' digits no rule tells apart; of titles those that are longer than any placeholder with a digit.
_DIGITS_ALIKE, _TITLE_CHARS = frozenset(["AdServingId", "UniversalAdId", "AdTitle"]), 5
#: Elements of which so much is to be found out that it is worth keeping.
_KEYED = _ASKING_MORE - {"AdServingId"}


def _shape_key(tree: Tree) -> tuple:
    """Equal for documents of one shape: names, levels, attributes (but ids of ads, which nothing is bound to) and those texts that facts ask for."""
    attrs = [id(a) if name != "Ad" else tuple(x if j % 2 == 0 or a[j - 1] != "id" else "" for j, x in enumerate(a)) for name, a in zip(tree.names, tree.attrs, strict=True)]
    texts = [x for name, x in zip(tree.names, tree.texts, strict=True) if name in _TOLD_BY_TEXT]
    return tuple(tree.names), tuple(tree.depth), tuple(attrs), tuple(texts)


def _shape(tree: Tree) -> tuple:
    """What follows from a document's elements alone: (its attributes, which must live as long, names, declared and inferred version, vendors' extensions, payloads, facts)."""
    names, kinds = tree.names, set(tree.names)
    vendors, payloads, facts = [], (), ()
    if not kinds.isdisjoint(_EXTENSIONS):
        vendors = [i for i, name in enumerate(names) if name in _EXTENSIONS and not _standard(tree, i)]
        if "VAST" in kinds:
            payloads = tuple(_payloads(tree).items())
    if not kinds.isdisjoint(_ASKING_MORE):
        found = _Facts(tree)
        found.gather()
        found.finish()
        facts = tuple((i, found.out[i]) for i in sorted(found.out))
    return tree.attrs, kinds, _value(tree.attrs[0], "version"), inferred_version(tree, 0, len(names), kinds), vendors, payloads, facts


class _Rows:
    """Elements of some documents while they are gathered, as flat columns; what follows from their order is worked out at once."""

    def __init__(self):
        self.names, self.parents, self.links, self.depth, self.texts, self.at, self.attrs = [], [], [], [], [], [], []
        self.cdata, self.not_opened, self.vendors = [], [], []
        self.bare: dict[int, list[str]] = {}
        self.facts: dict[int, list[str]] = {}
        self.payloads: dict[int, tuple] = {}
        #: Elements whose grandchildren rules ask for.
        self.asking: list[int] = []
        self.starts: list[int] = []
        #: (first element, last, where its lines begin) of the documents of several lines.
        self.lined: list[tuple[int, int, np.ndarray]] = []
        #: Runs of elements with equal document values.
        self.runs: list[int] = []
        self.told: list[tuple] = []
        self.playlists: list[bool] = []
        #: By a document's number: the context values of further documents that are like it.
        self.copies: dict[int, list[tuple]] = {}
        self.copied = 0

    def __len__(self) -> int:
        return len(self.names)

    def add(self, own: tuple, tree: Tree, data: bytes, shapes: dict[tuple, tuple] | None = None) -> None:
        """One document whose context values are ``own``; its elements up to the error if it isn't well formed.

        ``shapes`` keeps what follows from the elements of documents whose equal tags have the same list of attributes, as ``parse_plain`` gives them.
        """
        base, names, attrs = len(self.names), tree.names, tree.attrs
        self.starts.append(base)
        if not names:
            for column, value in ((self.names, "__empty__"), (self.parents, -1), (self.links, -1), (self.depth, 0), (self.texts, ""), (self.at, 0), (self.attrs, []), (self.runs, base), (self.playlists, False)):
                column.append(value)
            self.told.append((*own, tree.error, "__empty__", None, None, None, effective_version("__empty__", own[_FORCED], None, None)))
            return
        n = len(names)
        self.names += names
        self.parents += tree.parents
        self.texts += tree.texts
        self.attrs += attrs
        self.at += tree.at
        if tree.cdata:
            self.cdata += [i + base for i in tree.cdata]
        if tree.not_opened:
            self.not_opened += [i + base for i in tree.not_opened]
        if b"\n" in data:
            self.lined.append((base, base + n, np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1])))
        key = shapes is not None and not _KEYED.isdisjoint(names) and _shape_key(tree)
        shape = shapes.get(key) if key else None
        if shape is None:
            shape = _shape(tree)
            if key:
                if len(shapes) >= _KNOWN_SHAPES:
                    shapes.clear()
                shapes[key] = shape
        _, kinds, version, floor, vendors, payloads, facts = shape
        if vendors:
            self.vendors += [i + base for i in vendors]
        if payloads:
            self.payloads |= {i + base: x for i, x in payloads}
        if facts:
            self.facts |= {i + base: x for i, x in facts}
        if not kinds.isdisjoint(_ASKING_MEDIA) or b"skip" in data or b"&#" in data:
            self.asking += [i + base for i, name in enumerate(names) if name in ASKING_GRAND]
        head = (*own, tree.error, names[0], version, floor, None, effective_version(names[0], own[_FORCED], version, floor))
        self.runs.append(base)
        self.told.append(head)
        self.playlists.append(names[0] == "VMAP")
        depth, parents = tree.depth, tree.parents
        if names[0] == "VMAP" and "VAST" in kinds and not tree.error:
            depth, parents = list(depth), list(parents)
            for i, path in _embedded(tree):
                end = _end(tree, i)
                parents[i] = -1
                depth[i:end] = [d - tree.depth[i] for d in depth[i:end]]
                self.runs += [base + i, base + end] if end < n else [base + i]
                version, floor = _value(attrs[i], "version"), inferred_version(tree, i, end)
                self.told += [(*own, None, "VAST", version, floor, path, effective_version("VAST", None, version, floor))] + ([head] if end < n else [])
                self.playlists += [False, True] if end < n else [False]
        self.links += parents
        self.depth += depth

    def add_plain(self, owns: list[tuple], found: _Plain) -> None:
        """The documents of ``found``, whose context values are ``owns``."""
        if not len(found.documents):
            return
        base = len(self.names)
        starts = (found.starts + base).tolist()
        self.names += np.array(found.names, object)[found.name].tolist()
        parents, depth = found.parents.tolist(), found.depth.tolist()
        self.parents += parents
        self.links += parents
        self.depth += depth
        self.texts += found.texts.to_numpy(zero_copy_only=False).tolist()
        self.attrs += found.attrs.tolist()
        self.at += found.at.tolist()
        self.cdata += (np.flatnonzero(found.cdata) + base).tolist()
        self.not_opened += (np.flatnonzero(found.not_opened) + base).tolist()
        self.asking += (found.asking + base).tolist()
        self.starts += starts
        self.runs += starts
        self.playlists += [False] * len(starts)
        ends = [*starts[1:], len(self.names)]
        self.lined += [(starts[k], ends[k], lines) for k, lines in found.lined]
        versions: dict[tuple, tuple] = {}
        for d, i, floor in zip(found.documents.tolist(), starts, found.floors, strict=True):
            own, root = owns[d], self.names[i]
            key = (root, id(self.attrs[i]), floor, own[_FORCED])
            head = versions.get(key)
            if head is None:
                version = _value(self.attrs[i], "version")
                head = versions[key] = (None, root, version, floor, None, effective_version(root, own[_FORCED], version, floor))
            self.told.append((*own, *head))

    def copy(self, number: int, owns: list[tuple], size: int) -> None:
        """Further documents, with context values ``owns``, of ``size`` bytes, that are like the one of that number."""
        self.copies.setdefault(number, []).extend(owns)
        self.copied += len(owns) * (size + 256)

    def batch(self, names: frozenset[str] | None = None, roots: bool = True, kinds: bool = False, numbered: int | None = None, counted: bool = False) -> pa.RecordBatch:
        """The rows of all elements; with ``names`` of those alone and, with ``roots``, of the first of each document; with ``kinds`` one row for each kind.

        With ``numbered`` members have their document's number, counted from there, and their own in it; with ``counted`` there are those numbers alone, but for roots.
        """
        n = len(self.names)
        name = pa.array(self.names, pa.string())
        coded = name.dictionary_encode()
        known_names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        member = lambda some: np.array([k in some for k in known_names])[code]
        begin = np.repeat(self.starts, np.diff([*self.starts, n]))
        parent, link, depth = (np.array(x, np.int64) for x in (self.parents, self.links, self.depth))
        parent, link = np.where(parent < 0, -1, parent + begin), np.where(link < 0, -1, link + begin)
        by_parent = np.argsort(parent, kind="stable")
        pos, nth = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for order, keys, out in ((by_parent, (parent,), pos), (np.argsort((parent + 1) * len(known_names) + code, kind="stable"), (parent, code), nth)):
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
            out[order] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        root = parent < 0
        pos[root], nth[root] = 0, 0
        own_vendor = np.zeros(n, bool)
        own_vendor[self.vendors] = True
        # elements at one place, in all documents, share trail and spot: these are made once
        indexed = member(INDEXED)
        place, vendor = np.zeros(n, np.int64), np.zeros(n, bool)
        trails, spots, first, main, total = [], [], [], [], 0
        for d in range(int(depth.max()) + 1):
            rows = np.flatnonzero(depth == d)
            above = link[rows]
            if not d:
                _, some, inverse = np.unique(code[rows], return_index=True, return_inverse=True)
                trail = name.take(pa.array(rows[some]))
                spot = pc.binary_join_element_wise(trail, "0 0", " ")
                ahead = middle = np.ones(len(some), bool)
            else:
                _, some, inverse = np.unique(_folded([place[above], code[rows], nth[rows], pos[rows]]), return_index=True, return_inverse=True)
                at = rows[some]
                up, own = place[above[some]] - total + len(trail), name.take(pa.array(at))
                step = pc.binary_join_element_wise(own, pa.array(nth[at]).cast(pa.string()), pa.array(pos[at]).cast(pa.string()), " ")
                trail, spot = pc.binary_join_element_wise(trail.take(pa.array(up)), own, "/"), pc.binary_join_element_wise(spot.take(pa.array(up)), step, "/")
                ahead = ahead[up] & ((nth[at] == 0) | indexed[at])
                middle = middle[up] & ((nth[at] == 0) if d == 2 else True)
                vendor[rows] = vendor[above] | own_vendor[above]
            place[rows] = total + inverse
            total += len(some)
            for gathered, x in ((trails, trail), (spots, spot), (first, ahead), (main, middle)):
                gathered.append(x)
        trail, spot, first, main = pa.concat_arrays(trails), pa.concat_arrays(spots), np.concatenate(first), np.concatenate(main)
        cdata, opened = np.zeros(n, bool), np.ones(n, bool)
        cdata[self.cdata], opened[self.not_opened] = True, False
        lines, cols = np.ones(n, np.int64), np.array(self.at, np.int64) + 1
        for i, end, starts in self.lined:
            lines[i:end] = np.searchsorted(starts, cols[i:end] - 1, side="right")
            cols[i:end] -= starts[lines[i:end] - 1]
        texts = pa.array(self.texts, pa.string())
        holder = np.where(root, 0, parent)
        run = np.repeat(np.arange(len(self.runs)), np.diff([*self.runs, n]))

        chosen = None
        if names is not None:
            fits = member(names)
            if roots:
                fits[self.starts] = True
            chosen = np.flatnonzero(fits)
        # of the children those that rules ask for, each with what they ask
        all_kids = by_parent[np.searchsorted(parent[by_parent], 0) :]
        kid_ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(parent[all_kids], minlength=n))]), pa.int32())
        kid_names = pc.binary_join(pa.ListArray.from_arrays(kid_ends, pc.binary_join_element_wise("", coded.dictionary, "", "/").take(pa.array(code[all_kids]))), "")
        playlist = member({"VMAP", "AdBreak", "AdSource", "TrackingEvents"}) & np.array(self.playlists)[run]
        with_attrs, with_texts, under = member(TOLD_ATTRS), member(TOLD_TEXTS), member(TOLD_UNDER)
        told = all_kids[(under[parent[all_kids]] & (with_attrs | with_texts)[all_kids]) | playlist[parent[all_kids]]]
        asks = np.zeros(n, bool)
        asks[self.asking] = True
        grand = (~root) & (parent[holder] >= 0) & member({"MediaFiles", "TrackingEvents", "VASTAdData"})[holder] & (nth[holder] == 0)
        top = np.where(grand, parent[holder], 0)
        grand &= asks[top]
        grands = np.flatnonzero(grand)
        grands = grands[np.argsort(top[grands], kind="stable")]

        members = None
        if kinds:
            text_code = texts.dictionary_encode().indices.to_numpy()
            titles = member(_DIGITS_ALIKE) & (~member({"AdTitle"}) | (pc.utf8_length(texts).to_numpy() >= _TITLE_CHARS))
            alike_code = _digits_alike(texts, member(_URLS), titles).dictionary_encode().indices.to_numpy()
            attr_code = self._attr_codes()
            seen: dict = {}
            number_of = lambda what, x: seen.setdefault((what, x), len(seen) + 1)
            document = np.array([number_of("d", x[_OWN:]) for x in self.told])[run]
            names_code = kid_names.dictionary_encode().indices.to_numpy()
            # of texts of Impressions it counts alone whether they are equal; of places those of playlists
            told_text = np.where(with_texts, text_code + 1, 0)
            shown = told[member({"Impression"})[told]]
            told_text[shown] = 0
            shown = shown[pc.binary_length(texts.take(pa.array(shown))).to_numpy() > 0]
            _, some, inverse = np.unique(_folded([parent[shown], text_code[shown]]), return_index=True, return_inverse=True)
            told_text[shown] = some[inverse] - np.searchsorted(parent[shown], parent[shown]) + 1
            own = _folded([code[told], told_text[told], np.where(with_attrs, attr_code + 1, 0)[told], cdata[told], np.where(playlist[parent[told]], lines[told], 0), np.where(playlist[parent[told]], cols[told], 0)])
            told_code, grand_code, fact_code, paid_code = (np.zeros(n, np.int64) for _ in range(4))
            for out, of, x in ((told_code, parent[told], own), (grand_code, top[grands], _folded([code[parent[grands]], code[grands], attr_code[grands]]))):
                owners, number = _equal_lists(of, x)
                out[owners] = number + 1
            for i, x in self.facts.items():
                fact_code[i] = number_of("f", tuple(x))
            for i, x in self.payloads.items():
                paid_code[i] = number_of("p", x)
            whole = _folded([document, place, alike_code, attr_code, names_code, told_code, grand_code, fact_code, paid_code, cdata, opened, vendor])
            _, chosen, kind = np.unique(whole, return_index=True, return_inverse=True)
            order = np.argsort(kind, kind="stable")
            # each element is one of its own document and of those that are like it
            which = np.repeat(np.arange(len(self.starts)), np.diff([*self.starts, n]))
            owns, sizes = [self.told[k] for k in run[self.starts].tolist()], np.ones(len(self.starts), np.int64)
            if self.copies:
                sizes[list(self.copies)] += [len(x) for x in self.copies.values()]
                owns = [x for d, own in enumerate(owns) for x in (own, *self.copies.get(d, ()))]
            each = sizes[which]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(kind, each, minlength=len(chosen)).astype(np.int64))])
            of, each = which[order], each[order]
            of = np.repeat((np.cumsum(sizes) - sizes)[of] - (np.cumsum(each) - each), each) + np.arange(offsets[-1])
            order = np.repeat(order, each)
            if counted:
                documents = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(of + numbered))
                own_root = begin[chosen] == chosen
                shown = np.repeat(own_root, np.diff(offsets))
                offsets = np.concatenate([[0], np.cumsum(np.where(own_root, np.diff(offsets), 0))])
                of, order = of[shown], order[shown]
            place_columns = [pa.array(x[order], pa.int32()) for x in (lines, cols, lines[holder], cols[holder])]
            if numbered is not None and not counted:
                place_columns += [pa.array(of + numbered), pa.array((np.arange(n) - begin)[order], pa.int32())]
            own = zip(*(x[:_OWN] for x in owns), strict=True)
            of = pa.array(of)
            values = [*(pa.array(x, pa.string()).take(of) for x in own), *place_columns]
            members = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(values, fields=list(_MEMBER if numbered is None or counted else _NUMBERED)))

        if chosen is None:
            at, number = None, np.arange(n)
        else:
            at, number = pa.array(chosen), np.full(n, -1)
            number[chosen] = np.arange(len(chosen))
            told, grands = told[number[parent[told]] >= 0], grands[number[top[grands]] >= 0]
        size = n if chosen is None else len(chosen)
        here = (lambda x, kind=None: pa.array(x if chosen is None else x[chosen], kind))
        some = (lambda x: x if at is None else x.take(at))
        ends = lambda of: pa.array(np.concatenate([[0], np.cumsum(np.bincount(number[of], minlength=size))]), pa.int32())
        twins = np.zeros(n, bool)
        twins[holder[(nth == 1) & ~root]] = True
        # pairs of parent and child that the content model doesn't know
        place_of = {k: c for c, k in enumerate(known_names)}
        known = np.array(sorted(place_of[p] * len(known_names) + place_of[c] for p, c in PAIRS if p in place_of and c in place_of), np.int64)
        odd = ~root & ~np.isin(code[holder] * len(known_names) + code, known)

        def lists(of: np.ndarray, rows: np.ndarray, make):
            """A list for each chosen element; elements that are not sorted by number are put in order."""
            by = np.argsort(number[of], kind="stable") if chosen is not None else np.arange(len(of))
            return pa.ListArray.from_arrays(ends(of), make(rows[by]))

        kids = lists(
            parent[told], told,
            lambda r: pa.StructArray.from_arrays([name.take(pa.array(r)), texts.take(pa.array(r, mask=~with_texts[r])), pa.array(cdata[r]), pa.array(lines[r], pa.int32()), pa.array(cols[r], pa.int32()), self._attr_rows(r, with_attrs[r])], fields=list(_KID)),
        )
        grand_list = lists(top[grands], grands, lambda r: pa.StructArray.from_arrays([name.take(pa.array(parent[r])), name.take(pa.array(r)), self._attr_rows(r)], fields=list(_GRAND)))
        paid = [self.payloads.get(i) for i in (range(n) if chosen is None else chosen.tolist())] if self.payloads else None
        paid_column = lambda k, kind: pa.array([x[k] if x else None for x in paid], kind) if paid else pa.nulls(size, kind)
        rows = np.arange(n) if chosen is None else chosen
        attr = self._attr_rows(rows)
        document, spot_of = here(run), here(place)
        columns = {c: pa.array(x, NODE_SCHEMA.field(c).type).take(document) for c, x in zip((*CONTEXT, "parse_error", "root_name", "root_version", "inferred", "base", "ver"), zip(*self.told, strict=True), strict=True)}
        columns |= {
            "node_id": here(np.arange(n) - begin, pa.int32()), "parent_id": here(np.where(root, -1, parent - begin), pa.int32()), "depth": here(depth, pa.int32()),
            "name": some(name), "pos": here(pos, pa.int32()), "name_idx": here(nth, pa.int32()), "text": some(texts), "has_cdata": here(cdata), "opened": here(opened),
            "trail": trail.take(spot_of), "spot": spot.take(spot_of), "first": here(first[place]), "main": here(main[place]), "vendor_ext": here(vendor), "line": here(lines, pa.int32()), "col": here(cols, pa.int32()),
            "up_line": here(lines[holder], pa.int32()), "up_col": here(cols[holder], pa.int32()),
            "bare_attrs": pa.array([self.bare.get(i) for i in rows.tolist()] if self.bare else [None] * size, pa.list_(pa.string())), "attr": attr, "facts": self._maps([self.facts.get(i) for i in rows.tolist()] if self.facts else [None] * size),
            "odd": here(odd), "twins": here(twins), "kid_names": some(kid_names),
            "payload": paid_column(0, pa.string()), "native": paid_column(1, pa.string()), "ctv_from": paid_column(2, pa.int32()), "ctv_to": paid_column(3, pa.int32()),
            "kids": kids, "grand": grand_list,
        }
        if counted:
            return pa.RecordBatch.from_arrays([*(columns[f.name] for f in NODE_SCHEMA), members, documents], schema=COUNTED_SCHEMA)
        if kinds:
            return pa.RecordBatch.from_arrays([*(columns[f.name] for f in NODE_SCHEMA), members], schema=KIND_SCHEMA if numbered is None else NUMBERED_SCHEMA)
        return pa.RecordBatch.from_arrays([columns[f.name] for f in NODE_SCHEMA], schema=NODE_SCHEMA)

    def _attr_codes(self) -> np.ndarray:
        """Equal numbers for equal attributes; values of ``id`` don't count, as rules ask only whether there is one (but all of a playlist's root)."""
        by_value: dict[tuple, int] = {}
        _, first, inverse = np.unique(np.fromiter(map(id, self.attrs), np.int64, len(self.attrs)), return_index=True, return_inverse=True)
        codes = np.zeros(len(first), np.int64)
        for k, i in enumerate(first.tolist()):
            a = self.attrs[i]
            if a:
                key = tuple(a)
                if "id" in key[::2] and self.names[i] != "VMAP":
                    key = tuple([x if j % 2 == 0 or a[j - 1] != "id" else "" for j, x in enumerate(a)])
                codes[k] = by_value.setdefault(key, len(by_value) + 1)
        return codes[inverse]

    def _attr_rows(self, rows: np.ndarray, mask: np.ndarray | None = None) -> pa.MapArray:
        """The attributes of some elements, null outside the mask."""
        some = [self.attrs[i] for i in rows.tolist()]
        for i, a in zip(rows.tolist(), some, strict=True):
            if a and i not in self.bare and (":" in (names := " ".join(a[::2])) or "xmlns" in names) and any([":" in x or x == "xmlns" for x in a[::2]]):
                self.bare[i] = [x for x in a[::2] if ":" not in x and x != "xmlns"]
        return self._maps(some, mask)

    def _maps(self, some: list[list[str] | None], mask: np.ndarray | None = None) -> pa.MapArray:
        """Maps of names and values, of local names; what has no prefix is told apart where others have one. Null outside the mask."""
        counts, keys, values = [0], [], []
        for a in some if mask is None else [a if m else None for a, m in zip(some, mask.tolist(), strict=True)]:
            if a:
                names = a[::2]
                if "xmlns" in names or ":" in " ".join(names):
                    own: dict[str, str] = {}
                    for x, y in zip(names, a[1::2], strict=True):
                        own.setdefault(x.rpartition(":")[2], y)
                    keys += own
                    values += own.values()
                else:
                    keys += names
                    values += a[1::2]
            counts.append(len(keys))
        ends = pa.array(counts, pa.int32()) if mask is None else pa.array(counts, pa.int32(), mask=np.append(~mask, False))
        return pa.MapArray.from_arrays(ends, pa.array(keys, pa.string()), pa.array(values, pa.string()))


def _folded(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row, equal where all columns are; columns are numbers from 0."""
    out, size = np.zeros(len(columns[0]), np.int64), 1
    for x in columns:
        x = x.astype(np.int64)
        most = int(x.max(initial=0)) + 1
        if size * most >= 1 << 62:
            some, out = np.unique(out, return_inverse=True)
            size = len(some)
        out = out * most + x
        size *= most
    return out


def _equal_lists(of: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owners, equal numbers from 0 for those whose values are equal, one by one) of values sorted by owner."""
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    ends = np.append(starts, len(of)).astype(np.int32) * 8
    lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values, np.int64))])
    return of[starts], lists.dictionary_encode().indices.to_numpy()


def _digits_alike(texts: pa.StringArray, urls: np.ndarray, titles: np.ndarray | None = None) -> pa.StringArray:
    """``texts`` with every digit of web URLs, and of ``titles``, a 0, and without brackets every run of digits: no rule tells digits of
    a URL apart, but for those of encoded characters, nor, outside macros, how many there are."""
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
    digit = (data >= 48) & (data <= 57)
    alike = pa.StringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(np.where(digit, np.uint8(48), data)))
    # the first digit of each run stays
    kept = ~digit
    kept[:1] = True
    kept[1:] |= ~digit[:-1]
    kept[ends[:-1][ends[:-1] < len(data)]] = True
    short_ends = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)[ends]
    short = pa.StringArray.from_buffers(len(texts), pa.py_buffer(short_ends), pa.py_buffer(np.where(digit, np.uint8(48), data)[kept]))
    some = pc.and_(pc.or_(pc.starts_with(texts, "http://"), pc.starts_with(texts, "https://")), pa.array(urls))
    whole = data.tobytes()
    if b"%" in whole:
        some = pc.and_(some, pc.invert(pc.match_substring(texts, "%")))
    if titles is not None:
        some = pc.or_(some, pa.array(titles))
    if b"[" in whole:
        short = pc.if_else(pc.match_substring(texts, "["), alike, short)
    return pc.if_else(some, short, texts)


#: Where a document's digits don't matter to rules: values of ads' ids, whole URLs up to an encoded character or a macro's end, and some texts.
_QUOTED = rb"""(?:[ \n][^<>"']*(?:"[^"<>]*"[^<>"']*)*)?>"""
_MUTE = re.compile(
    rb'<Ad id="[^"<>&%]*"|<(?:AdServingId|UniversalAdId)' + _QUOTED + rb"[^<&]*|<AdTitle>[^<&\s][^<&]{" + str(_TITLE_CHARS - 2).encode() + rb",}[^<&\s]</AdTitle>"
    rb"|<(?:" + "|".join(MACRO_ELEMENTS).encode() + rb")" + _QUOTED + rb"(?:<!\[CDATA\[)?https?://[^%<&\]]*"
)
_ZEROS = bytes.maketrans(b"123456789", b"000000000")
_KNOWN_TEXTS = 4096


class _Alike:
    """Tells documents that rules can't tell apart, as their texts differ in some digits alone (``_MUTE``) and stand at equal places.

    Texts are compared with all digits as 0 first. Of those that are equal so, only the digits elsewhere are looked at.
    """

    def __init__(self):
        self.digits: dict[bytes, np.ndarray] = {}

    def keys(self, texts: pa.StringArray, owns: list[tuple]) -> list[tuple | None]:
        """A key for each text, equal for documents alike; None where a document is looked at by itself. All are None where texts hardly repeat."""
        each = texts.cast(pa.binary()).to_pylist()
        blank = [x.translate(_ZEROS) for x in each]
        if len(set(blank)) * 2 > len(blank):
            return [None] * len(blank)
        out: list[tuple | None] = []
        for x, b, own in zip(each, blank, owns, strict=True):
            # of Impressions it counts whether they are equal; playlists' places count
            if not x or x.count(b"Impression") > 2 or b"&#" in x or b"VMAP" in x:
                out.append(None)
                continue
            at = self.digits.get(b)
            if at is None:
                if len(self.digits) >= _KNOWN_TEXTS:
                    self.digits.clear()
                raw = np.frombuffer(x, np.uint8)
                tells = (raw >= 48) & (raw <= 57)
                for m in _MUTE.finditer(x):
                    tells[m.start() : m.end()] = False
                at = self.digits[b] = np.flatnonzero(tells)
            out.append((own[_OWN:], b, np.frombuffer(x, np.uint8)[at].tobytes()))
        return out


def shred(documents: DataFrame, xml: str = "xml", names: list[str] | None = None, roots: bool = True, kinds: bool = False, numbered: bool = False, counted: bool = False, summed: tuple | None = None) -> DataFrame:
    """The nodes table: a row for each element of each document, in document order within it.

    ``documents`` has doc_id and ``xml``; further columns of CONTEXT are carried where present. A document that isn't well formed
    has its elements up to the error, each with ``parse_error``, which rules leave out; without any, or null, it has one row, ``__empty__``. ``attr`` has local names; ``bare_attrs`` those
    without prefix, null where all are. ``kid_names`` has each child's name between slashes, ``twins`` tells that one comes twice, ``odd``
    that the content model doesn't know the element below its parent. ``kids`` repeats what rules ask of an element's children, so that they need no
    join, ``grand`` of the children of some of those; ``facts`` is what they ask of parents, siblings and bound elements. Elements in a standardised CTV extension in
    its place have the versions that it fits (``ctv_from``, ``ctv_to``), ``payload``, its type if it has the right shape, and ``native``, the trail
    of the element that it stands for. ``trail`` is the names from the root, ``opened`` tells a tag without prefix that isn't closed at once; ``spot`` adds each step's number among
    its namesakes and among all siblings; ``first`` tells that no step but the indexed ones is a second of its name, ``main`` that the
    third isn't. VAST inside a playlist's VASTAdData counts as a document below ``base``, with a root, version and trails of
    its own. Documents are read one at a time, so memory is bounded by the largest (4 MiB).

    With ``names`` only elements of these names come out, and with ``roots`` the first row of each document: what asks for a few
    elements need not have all others made into rows. Documents are read whole, and rows are the same.

    With ``kinds`` elements that no rule can tell apart, of all documents that a task gathers at once, are one row, the first one's, and ``members``
    lists doc_id, caller, policy_id and the places of each: documents repeat most of their elements, which rules then look at once.
    They are equal in all that rules ask of them and of their documents; doc_id, caller, policy_id, node_id, lines and columns, values of ``id``, digits of web URLs
    (without encoded characters) and titles, and the texts of Impressions in ``kids`` (where it counts whether they are equal) are one member's. Of documents
    that differ in such digits alone one is parsed for all. With ``numbered`` members have ``document``, a number, greater
    in each further batch's upper 32 bits, and ``node``, their node_id: rows of a document are in one batch. With ``counted`` a kind has ``documents``, these
    numbers alone, and ``members`` are those of roots: of other elements it doesn't count then where they stand.

    ``summed``, (a function, its type), makes something else of each batch of rows, in which documents are whole, before it leaves the task's Python.
    """
    some = None if names is None else frozenset(names)
    types = dict(documents.dtypes)
    defaults = {"was_escaped": F.lit(False), "wrapper_depth": F.lit(0), "max_wrapper_depth": F.lit(5)}
    kind = lambda c: "boolean" if c == "was_escaped" else "int" if "depth" in c else "string"
    context = [(F.col(c) if c in types else F.lit(None)).cast(kind(c)).alias(c) for c in CONTEXT]
    rows = documents.select(*context, F.col(xml).alias("xml")).withColumns({c: F.coalesce(c, v) for c, v in defaults.items()})

    def made(out: _Rows, number: int) -> pa.RecordBatch:
        batch = out.batch(some, roots, kinds, number << 32 if numbered or counted else None, counted)
        return summed[0](batch) if summed else batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known, shapes, alike, seen, number = _Rows(), {}, {}, _Alike(), {}, 0
        for batch in batches:
            column = pc.fill_null(batch.column("xml"), "").cast(pa.string())
            context = list(zip(*(batch.column(c).to_pylist() for c in CONTEXT), strict=True))
            size = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())])
            begin = 0
            while begin < len(column):
                end = max(begin + 1, int(np.searchsorted(size, size[begin] + CHUNK_BYTES, side="right")) - 1)
                texts, owns = column.slice(begin, end - begin), context[begin:end]
                keys = alike.keys(texts, owns) if kinds else [None] * len(owns)
                # documents like one that is there are its copies; of the others alike the first is taken apart
                first: dict[tuple, int] = {}
                copies: dict[int, list[tuple]] = {}
                if any(keys):
                    chosen = []
                    for d, key in enumerate(keys):
                        if key in seen:
                            out.copy(seen[key], [owns[d]], len(key[1]))
                        elif key is not None and key in first:
                            copies.setdefault(first[key], []).append(owns[d])
                        else:
                            if key is not None:
                                first[key] = len(chosen)
                            chosen.append(d)
                    texts, owns, keys = texts.take(pa.array(chosen, pa.int64())), [owns[d] for d in chosen], [keys[d] for d in chosen]

                def note(d: int, at: int) -> None:
                    if keys[d] is not None:
                        seen[keys[d]] = at
                        if d in copies:
                            out.copy(at, copies[d], len(keys[d][1]))

                found, base = _Plain(texts, known), len(out.starts)
                out.add_plain(owns, found)
                for n, d in enumerate(found.documents.tolist()):
                    note(d, base + n)
                for d in found.left.tolist():
                    text = texts[d].as_py()
                    plain = parse_plain(text, known)
                    if plain:
                        out.add(owns[d], *plain, shapes)
                    else:
                        out.add(owns[d], *parse(text))
                    note(d, len(out.starts) - 1)
                    if len(out) >= KIND_ELEMENTS:
                        yield made(out, number)
                        out, seen, number = _Rows(), {}, number + 1
                if len(out) >= (KIND_ELEMENTS if kinds else 16384) or out.copied >= ALIKE_BYTES:
                    yield made(out, number)
                    out, seen, number = _Rows(), {}, number + 1
                begin = end
        if len(out):
            yield made(out, number)

    return rows.mapInArrow(run, summed[1] if summed else COUNTED_TYPES if kinds and counted else NUMBERED_TYPES if kinds and numbered else KIND_TYPES if kinds else NODE_TYPES)


def whole_batches(batches: Iterator[pa.RecordBatch], numbers) -> Iterator[pa.Table]:
    """The rows of each of the shredder's batches, in a table each; ``numbers`` gives documents' numbers of some rows, one for each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        number = numbers(batch) >> 32
        begin = 0
        for at in np.flatnonzero(np.concatenate([[last is not None and last != number[0]], number[1:] != number[:-1]])).tolist():
            held.append(batch.slice(begin, at - begin))
            yield pa.Table.from_batches(held)
            held, begin = [], at
        held.append(batch.slice(begin))
        last = number[-1]
    if held:
        yield pa.Table.from_batches(held)


class ShredXml:
    """A table function: the elements of one document, for SQL with LATERAL. With a second argument, an array of names, those of these names alone."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def eval(self, xml: str | None, names: list[str] | None = None):
        tree, data = parse_plain(xml or "", self.known) or parse(xml or "")
        counts: dict[tuple[int, str], int] = {}
        starts = [0, *accumulate(len(x) + 1 for x in data.split(b"\n"))]
        for i, (name, parent) in enumerate(zip(tree.names, tree.parents, strict=True)):
            if names is not None and name not in names:
                continue
            nth = counts.get((parent, name), 0)
            counts[parent, name] = nth + 1
            own: dict[str, str] = {}
            for k in range(0, len(tree.attrs[i]), 2):
                own.setdefault(tree.attrs[i][k].rpartition(":")[2], tree.attrs[i][k + 1])
            line = bisect_right(starts, tree.at[i])
            yield i, parent, tree.depth[i], name, nth, tree.texts[i], line, tree.at[i] - starts[line - 1] + 1, own, tree.error


SHRED_ROW = "node_id int, parent_id int, depth int, name string, name_idx int, text string, line int, col int, attr map<string,string>, parse_error string"


def register_shred_xml(spark: SparkSession, name: str = "shred_xml") -> None:
    """Makes ``SELECT … FROM documents, LATERAL shred_xml(xml)`` work, or ``shred_xml(xml, array('Ad', …))``. A document without elements has no rows."""
    spark.udtf.register(name, F.udtf(ShredXml, returnType=SHRED_ROW))
