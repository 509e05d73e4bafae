"""Pieces of saved results that many schemas share: boxes, texts, page sizes, hints, sidecar names and data images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of box corners and of what holds a box; names of sizes and numbers; texts.
CORNERS = (("x0", "y0", "x1", "y1"), ("left", "top", "right", "bottom"), ("xmin", "ymin", "xmax", "ymax"))
HOLDERS = ("bbox", "box", "rect", "region", "coordinate", "coordinates", "polygon", "poly", "dt_poly")
WIDTHS, HEIGHTS = ("width", "page_width", "image_width", "w"), ("height", "page_height", "image_height", "h")
NUMBERS, INDEXES = ("page_number", "page_num", "page_no", "number"), ("page_index", "page_idx", "index")
TEXTS = ("natural_text", "text", "content", "markdown", "value", "rec_text")


def _number(c: Column) -> Column:
    """The finite number that a value states, else null; the value is worked out once."""
    return F.get(F.filter(F.array(c.try_cast("double")), lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(0))


def _at(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, path)


def _once(value: Column, use) -> Column:
    """use(value) with the value worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ordered(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box with its corners in order; null unless all are numbers."""
    at = lambda v, pick, i: pick(F.get(v, F.lit(i)), F.get(v, F.lit(i + 2)))
    box = lambda v: F.struct(at(v, F.least, 0).alias("x0"), at(v, F.least, 1).alias("y0"), at(v, F.greatest, 0).alias("x1"), at(v, F.greatest, 1).alias("y1"))
    return _once(F.array(x0, y0, x1, y1), lambda v: F.when(~F.exists(v, lambda x: x.isNull()), box(v)))


def _extent(xs: Column, ys: Column) -> Column:
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _from_list(value: Column) -> Column:
    """A box from four numbers, from three flat pairs or more, or from three points or more, of which those that are no numbers
    are left out."""

    def from_flat(flat: Column) -> Column:
        side = lambda odd: F.filter(flat, lambda v, i: i % 2 == odd)
        whole = (F.size(flat) >= 6) & (F.size(flat) % 2 == 0) & ~F.exists(flat, lambda v: v.isNull())
        return F.when(F.size(flat) == 4, _ordered(*[F.get(flat, F.lit(i)) for i in range(4)])).when(whole, _extent(side(0), side(1)))

    def from_points(points: Column) -> Column:
        known = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        some = F.when((F.size(points) >= 3) & ~F.exists(points, lambda p: F.coalesce(p["n"], F.lit(0)) < 2), known)
        return _once(some, lambda k: F.when(F.size(k) > 0, _extent(F.transform(k, lambda p: p["x"]), F.transform(k, lambda p: p["y"]))))

    numbers = F.transform(F.from_json(value, "array<string>"), _number)
    pairs = F.transform(F.from_json(value, "array<array<string>>"), lambda p: F.struct(F.size(p).alias("n"), _number(F.get(p, F.lit(0))).alias("x"), _number(F.get(p, F.lit(1))).alias("y")))
    return F.when(value.rlike(r"^\s*\[\s*\["), _once(pairs, from_points)).otherwise(_once(numbers, from_flat))


def _by_names(value: Column, names: Column) -> list[Column]:
    """Boxes by named corners, then by place and size, of an object with these names at its top."""
    sized = lambda v: _ordered(v["x"], v["y"], v["x"] + v["w"], v["y"] + v["h"])
    placed = F.struct(*[_number(_at(value, f"$.{c}")).alias(c[0]) for c in ("x", "y", "width", "height")])
    corners = [F.when(F.array_contains(names, some[0]), _ordered(*[_number(_at(value, f"$.{c}")) for c in some])) for some in CORNERS]
    return [*corners, F.when(F.array_contains(names, "x"), _once(placed, sized))]


def coerced_box(payload: Column) -> Column:
    """The box (struct of x0, y0, x1, y1; null if none) that a JSON value states: by corners, by place and size, by a list of
    four numbers, flat pairs or points, or by any of these one level down. An object's names are read once, and only what it has
    is looked for in it."""
    inner = lambda value: F.when(value.isNotNull(), _once(F.json_object_keys(value), lambda names: F.coalesce(*_by_names(value, names), _from_list(value))))
    held = lambda value, names: [F.when(F.array_contains(names, name), _once(_at(value, f"$.{name}"), inner)) for name in HOLDERS]
    whole = lambda value: _once(F.json_object_keys(value), lambda names: F.coalesce(*_by_names(value, names), *held(value, names), _from_list(value)))
    return _once(payload, whole)


def joined_pieces(pieces: Column, separator: str = "\n") -> Column:
    """Texts joined; with a separator, one that equals the text before it is left out, as are empty ones. Null for none."""
    some = F.filter(pieces, lambda x: F.coalesce(x, F.lit("")) != "")
    kept = F.filter(some, lambda x, i: (i == 0) | (x != F.get(some, i - 1))) if separator else some
    out = F.array_join(kept, separator)
    return F.when(F.length(out) > 0, out)


def stated_text(payload: Column) -> Column:
    """The first of the usual text fields of a JSON value, else its lines or spans joined."""
    lists = [joined_pieces(F.from_json(_at(payload, f"$.{c}"), "array<string>"), sep) for c, sep in (("lines", "\n"), ("spans", ""), ("children", "\n"), ("blocks", "\n"))]
    return F.coalesce(*[_at(payload, f"$.{c}") for c in TEXTS], *lists)


def page_size(payload: Column, default_width: Column, default_height: Column, extent_x: Column, extent_y: Column) -> tuple[Column, Column]:
    """Width and height that a page states under the usual names, else as a pair (an image's shape states its height first), else
    the given defaults, else the extent of its elements, else 1."""
    pair = lambda name, k: _number(F.get(F.from_json(_at(payload, f"$.{name}"), "array<double>"), F.lit(k)))
    positive = lambda c: F.when(c > 0, c)
    nested = lambda key, k: F.coalesce(*[x for name in ("page_size", "size", "dimensions", "img_shape", "image_size") for x in (positive(_number(_at(payload, f"$.{name}.{key}"))), positive(pair(name, 1 - k if name == "img_shape" else k)))])
    width = F.coalesce(*[positive(_number(_at(payload, f"$.{c}"))) for c in WIDTHS], nested("width", 0), default_width, extent_x, F.lit(1.0))
    height = F.coalesce(*[positive(_number(_at(payload, f"$.{c}"))) for c in HEIGHTS], nested("height", 1), default_height, extent_y, F.lit(1.0))
    return width, height


def page_number(payload: Column, place: Column) -> Column:
    """The number that a page states (1 at least), else its stated index and 1, else its place (from 0) and 1."""
    said = F.coalesce(*[_number(_at(payload, f"$.{c}")) for c in NUMBERS])
    index = F.coalesce(*[_number(_at(payload, f"$.{c}")) for c in INDEXES])
    return F.greatest(F.lit(1), F.coalesce(F.floor(said), F.floor(index) + 1, place + 1)).cast("int")


def hinted(detected: DataFrame, hints: DataFrame, strict: bool = False) -> DataFrame:
    """Sidecars (path, provider, ambiguous, valid) with hints (path, hint): a hint decides, by the whole path or, if no hint
    has that, by the file's name. Adds error for files that are no JSON, have no known schema, or (if strict) an ambiguous one."""
    name = F.element_at(F.split("path", "/"), -1)
    by_path = hints.select("path", F.col("hint").alias("_p"))
    by_name = hints.where(~F.col("path").contains("/")).select(F.col("path").alias("_name"), F.col("hint").alias("_n"))
    rows = detected.withColumn("_name", name).join(by_path, "path", "left").join(by_name, "_name", "left")
    rows = rows.withColumn("hint", F.coalesce("_p", "_n")).withColumn("provider", F.coalesce("hint", "provider"))
    error = F.when(~F.col("valid"), "invalid JSON").when(F.col("provider").isNull(), "unknown schema")
    if strict:
        error = error.when(F.col("ambiguous") & F.col("hint").isNull(), "ambiguous schema")
    return rows.withColumn("error", error).drop("_name", "_p", "_n")


def sidecar_path(sources: DataFrame, files: DataFrame, provider: str) -> DataFrame:
    """The saved output of a provider for each source (path, configured): the configured one, else the first that is there of
    ``name.ext.provider.json``, ``name.provider.json`` and ``name.provider.jsonl``, else the source itself. Files: path."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    names = F.array(F.concat("path", F.lit(f".{provider}.json")), F.concat(stem, F.lit(f".{provider}.json")), F.concat(stem, F.lit(f".{provider}.jsonl")))
    tried = sources.select("path", F.posexplode(names).alias("k", "candidate"))
    found = tried.join(files.select(F.col("path").alias("candidate")).distinct(), "candidate").groupBy("path").agg(F.min_by("candidate", "k").alias("found"))
    return sources.join(found, "path", "left").select("path", F.coalesce("configured", "found", "path").alias("sidecar"))


def data_images(rows: DataFrame, source: str) -> DataFrame:
    """Bytes of images given as data URIs: media_type, content and sha256; null for other sources, or where the body is no
    base64."""
    body = F.regexp_extract(source, r"(?is)^data:image/[a-z0-9.+-]+;base64,(.*)$", 1)
    clean = F.regexp_replace(body, r"\s+", "")
    content = F.when(F.length(clean) > 0, F.try_to_binary(clean, F.lit("base64")))
    rows = rows.withColumn("content", content)
    return rows.withColumns({"media_type": F.when(F.col("content").isNotNull(), F.lower(F.regexp_extract(source, r"(?i)^data:(image/[a-z0-9.+-]+);", 1))), "sha256": F.sha2("content", 256)})


def html_images(rows: DataFrame, html: str) -> DataFrame:
    """Images of a markup text: ordinal, src, alt, alignment and width_percent of each ``img`` with a source."""
    every = rows.withColumn("_m", F.regexp_extract_all(html, F.lit(r"(?i)<img\b([^>]*)/?>"), F.lit(1))).select(*rows.columns, F.posexplode("_m").alias("ordinal", "_a"))
    value = lambda name: F.trim(F.regexp_extract("_a", rf"""(?is)\b{name}\s*=\s*(['"])(.*?)\1""", 2))
    percent = F.regexp_extract(value("width"), r"^\s*(\d{1,3})%\s*$", 1).try_cast("int")
    align = F.lower(F.regexp_extract(value("style"), r"(?i)text-align\s*:\s*(left|center|right|justify)", 1))
    out = every.withColumns({"src": value("src"), "alt": value("alt"), "alignment": F.when(F.length(align) > 0, align), "width_percent": F.least(F.lit(100), percent)})
    return out.where(F.col("src") != "").drop("_a")


def markdown_bands(blocks: DataFrame, doc: str, width: float = 1000.0, height: float = 1000.0) -> DataFrame:
    """Blocks (doc, block_index from 0, kind, text) as elements of one page: each has a band of the page's height, which tells
    reading order and no place (coordinate_system says so)."""
    band = F.lit(height) / F.count(F.lit(1)).over(Window.partitionBy(doc))
    place = F.row_number().over(Window.partitionBy(doc).orderBy("block_index")) - 1
    rows = blocks.withColumns({"_b": band, "reading_order": place})
    return rows.select(*blocks.columns, "reading_order", F.lit(1).alias("page_number"), F.lit(0.0).alias("x0"), (F.col("reading_order") * F.col("_b")).alias("y0"), F.lit(width).alias("x1"), ((F.col("reading_order") + 1) * F.col("_b")).alias("y1"), F.lit("synthetic_reading_order_only").alias("coordinate_system"))


def layout_pages(payloads: DataFrame, path: str = "$.result.layoutParsingResults") -> DataFrame:
    """Pages of layout-parsing answers (doc_id, payload), one line or one response each: page_number, the page's markdown and its
    blocks with label, content, order and box. The answer of a server and a line of a saved result have the same form."""
    shape = "array<struct<prunedResult:struct<width:double,height:double,parsing_res_list:array<struct<block_id:int,block_label:string,block_content:string,block_order:int,block_bbox:array<double>>>>,markdown:struct<text:string>>>"
    pages = payloads.select("doc_id", "line", F.posexplode(F.from_json(F.get_json_object("payload", path), shape)).alias("k", "g"))
    # Pages are numbered on over the lines of a document.
    pages = pages.withColumn("page_number", F.row_number().over(Window.partitionBy("doc_id").orderBy("line", "k")))
    blocks = pages.select("doc_id", "page_number", F.col("g.markdown.text").alias("markdown"), F.posexplode_outer("g.prunedResult.parsing_res_list").alias("n", "b"))
    return blocks.select("doc_id", "page_number", "markdown", F.col("b.block_label").alias("label"), F.col("b.block_content").alias("text"), F.coalesce("b.block_order", F.col("n")).alias("reading_order"), *[F.get("b.block_bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def rejected_proposals(proposals: DataFrame, elements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Proposals (proposal_id, object_id, operation, candidate, value) that must not be applied, and why: an unknown object, an
    unknown candidate of it (named by its element or as ``engine:element``), or a text that is not exactly the candidate's.
    Candidates: object_id, engine, source_element_id, text."""
    known = elements.select("object_id", F.lit(True).alias("_there")).distinct()
    named = candidates.select("object_id", "text", F.explode(F.array_compact(F.array(F.col("source_element_id"), F.concat("engine", F.lit(":"), F.coalesce("source_element_id", F.lit("")))))).alias("candidate"))
    one = named.groupBy("object_id", "candidate").agg(F.collect_set("text").alias("_texts"))
    rows = proposals.join(known, "object_id", "left").join(one, ["object_id", "candidate"], "left")
    select = F.col("operation") == "select_text_candidate"
    reason = F.when(F.col("_there").isNull(), "unknown object").when(select & F.col("_texts").isNull(), "unknown text candidate").when(select & ~F.coalesce(F.array_contains("_texts", F.col("value")), F.lit(False)), "text differs from the candidate")
    return rows.withColumn("reason", reason).where("reason is not null").select(*proposals.columns, "reason")


def eligible(providers: DataFrame, mode: str, geometry: bool) -> DataFrame:
    """Add reason to providers (provider, modes, live, boxes): why one cannot serve a run of that mode, or null."""
    allowed = {"local": ["local"], "cloud": ["cloud"], "auto": ["local", "cloud"]}[mode]
    reason = F.when(~F.arrays_overlap("modes", F.array(*map(F.lit, allowed))), "mode").when(~F.col("live"), "saved evidence only")
    if geometry:
        reason = reason.when(~F.col("boxes"), "no geometry")
    return providers.withColumn("reason", reason)


def manifest_options(cases: DataFrame, base: DataFrame) -> DataFrame:
    """Options (case_id, section, name, value) of cases laid over those of a manifest (section, name, value): a case's own value
    wins, all others come from the manifest. Tags under their singular names count under the plural ones."""
    plural = {"language": "languages", "script": "scripts", "document_type": "document_types", "degradation": "degradations", "content_kind": "content_kinds"}
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in plural.items() for x in kv])[F.col("name")], F.col("name"))
    own = cases.where("name is not null").select("case_id", "section", name.alias("name"), "value")
    every = cases.select("case_id").distinct().join(F.broadcast(base.select("section", name.alias("name"), F.col("value").alias("base"))).limit(1000), how="cross")
    both = every.join(own, ["case_id", "section", "name"], "full")
    return both.select("case_id", "section", "name", F.coalesce("value", "base").alias("value"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files: path, sha256, format, width and height from the header (PNG, GIF, BMP; null for others), and one page without
    elements each. No pixel is decoded."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    number = lambda at, n, little: F.conv(F.hex(F.substring("content", at, n)) if not little else F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.hex(F.substring(F.col("content"), F.lit(at) + i, F.lit(1))))), ""), 16, 10).try_cast("long")
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp").when(head.startswith("FFD8"), "jpeg").when(head.startswith("49492A00") | head.startswith("4D4D002A"), "tiff")
    width = F.when(kind == "png", number(17, 4, False)).when(kind == "gif", number(7, 2, True)).when(kind == "bmp", number(19, 4, True))
    height = F.when(kind == "png", number(21, 4, False)).when(kind == "gif", number(9, 2, True)).when(kind == "bmp", number(23, 4, True))
    return rows.select("path", F.sha2("content", 256).alias("sha256"), kind.alias("format"), width.alias("width"), height.alias("height"), F.lit(1).alias("page_number"), F.lit("image").alias("source_type"))
