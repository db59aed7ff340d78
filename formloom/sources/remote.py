"""Structured extraction by a remote language service, off unless a key is configured.

Requests are built and replies unpacked with Column expressions; only the sending is Python, through a
transport that the caller gives, once for each request (:mod:`formloom.sources.replies`). The key goes into a header, never into an
address, a plan or a result. Replies are read as Python reads JSON, and filled to the caller's catalogue.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.functions import json as J
from formloom.functions.text import named
from formloom.operators.fill import filled
from formloom.plans.catalog import CATALOGUE, Catalogue, compiled
from formloom.session import shared_dir
from formloom.sources.replies import IN_FLIGHT, Transport, digest, send_once

# The placeholder for a key, the time limit and the error messages.
NO_KEY = "YOUR_API_KEY"
TIMEOUT = 30.0
EMPTY_REPLY = "API trả về phản hồi rỗng"
BAD_STATUS = "Lỗi gọi API (Status {status})"
FAILED = "Lỗi kết nối hoặc xử lý trích xuất"
NO_CATALOGUE = "Không tìm thấy file schema tại: {path}"
# End of fixed values.

#: What a request asks for, before the document's text; callers may give their own.
PROMPT = "Đọc văn bản dưới đây và điền các trường của lược đồ kèm theo. Chỉ dùng những gì có trong văn bản; trường nào không có thì để trống.\n\n"


def api_key(variable: str = "EXTRACTION_API_KEY", file: str | None = None) -> str:
    """From the environment, or else from a file; the placeholder without either."""
    key = os.environ.get(variable, NO_KEY)
    if key == NO_KEY and file and os.path.exists(file):
        try:
            with open(file, encoding="utf-8") as f:
                key = f.read().strip()
        except OSError:
            pass
    return key


def usable(key: str | None) -> bool:
    return bool(key) and key != NO_KEY


def read_catalogue(path: str) -> dict:
    """A catalogue from a JSON file; a missing file is an error with its path."""
    if not os.path.exists(path):
        raise FileNotFoundError(NO_CATALOGUE.format(path=path))
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def request_body(text: Column, catalogue: Catalogue | dict | None = None, prompt: str = PROMPT) -> Column:
    """The JSON request for a document's text."""
    schema = json.dumps(_compiled(catalogue).request(), ensure_ascii=False)
    contents = F.to_json(F.array(F.struct(F.array(F.struct(F.concat(F.lit(prompt), text).alias("text"))).alias("parts"))))
    return F.concat(F.lit('{"contents":'), contents, F.lit(',"generationConfig":{"responseMimeType":"application/json","responseSchema":' + schema + "}}"))


def _compiled(catalogue: Catalogue | dict | None) -> Catalogue:
    if catalogue is None:
        return CATALOGUE
    return catalogue if isinstance(catalogue, Catalogue) else compiled(catalogue)


def unpacked(replies: DataFrame, keep: list[str], typed: bool = True, catalogue: Catalogue | dict | None = None, fill: Callable[..., DataFrame] | None = None) -> DataFrame:
    """The record of each reply (http_status, body, error), filled to the catalogue, with status and error.

    Errors: a status other than 200, a body that isn't JSON, no candidates, and a first candidate without a text that is JSON. The record then
    has the defaults. ``fill`` makes another layout, as :func:`~formloom.operators.fill.filled_variants` does.
    """
    catalogue = _compiled(catalogue)
    rows = replies.select(*map(named, keep), "http_status", "error", J.marked(F.when(F.col("http_status") == 200, F.col("body"))).alias("_body"))
    # one step in each projection, as the next reads what it makes several times
    steps = {
        # nearly all replies are as they should be, and one parse reads them; the other steps get what is left
        "_quick": J.single_path(F.col("_body"), ("candidates", "content", "parts", "text")),
        "_odd": F.when(F.col("_quick").isNull(), F.col("_body")),
        "_root": F.expr(J.members("_odd")),
        "_candidates": F.expr(J.member("_root", "candidates")),
        "_kind": F.expr(J.kind_of("_candidates")),
        "_list": F.expr(J.elements("_candidates")),
        "_held": F.expr(J.members("_candidates")),
        "_plain": F.expr(f"CASE WHEN _kind NOT IN ('array', 'object') THEN {J.text_of('_candidates')} END"),
        "_first": F.get("_list", 0),
        "_message": F.expr(J.members("_first")),
        "_content": F.expr(J.member("_message", "content")),
        "_inner": F.expr(J.members("_content")),
        "_parts": F.expr(J.member("_inner", "parts")),
        "_part": F.get(F.expr(J.elements("_parts")), 0),
        "_last": F.expr(J.members("_part")),
        "_said": F.coalesce("_quick", F.expr(J.member("_last", "text"))),
        "_text": F.expr(f"CASE WHEN {J.is_string('_said')} THEN {J.text_of('_said')} END"),
        "_good": F.coalesce(J.is_json(F.col("_text")), F.lit(False)),
    }
    for name, step in steps.items():
        rows = rows.withColumn(name, step)
    # what Python would take for false
    none = (
        F.when(F.col("_kind") == "array", F.size("_list") == 0)
        .when(F.col("_kind") == "object", F.size("_held.keys") == 0)
        .when(F.col("_kind").isin("integer", "float"), F.coalesce(F.col("_plain").try_cast("double") == 0, F.lit(False)))
        .otherwise((F.col("_kind") == "null") | (F.col("_kind") == "string") & (F.col("_plain") == "") | (F.col("_kind") == "boolean") & (F.col("_plain") == "false"))
    )
    error = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit(f"{FAILED}: "), F.col("error")))
        .when(F.col("http_status").isNull(), F.lit(FAILED))
        .when(F.col("http_status") != 200, F.format_string(BAD_STATUS.format(status="%d"), "http_status"))
        .when(~F.expr(J.is_object("_body")), F.lit(FAILED))
        .when(F.col("_quick").isNull() & none, F.lit(EMPTY_REPLY))
        .when(~F.col("_good"), F.lit(FAILED))
    )
    rows = rows.withColumn("_error", error).select(*map(named, keep), "_error", F.when(F.col("_error").isNull(), F.col("_text")).alias("_json"))
    out = fill(rows, "_json", [*keep, "_error"], catalogue=catalogue) if fill else filled(rows, "_json", [*keep, "_error"], typed, catalogue, checked=True)
    status = F.when(F.col("_error").isNull(), "ok").otherwise("error")
    return out.select(*map(named, keep), status.alias("status"), F.col("_error").alias("error"), *(named(e.column) for e in catalogue.entries))


def extract_remote(documents: DataFrame, transport: Transport, keep: list[str], text: str = "text", catalogue: Catalogue | dict | None = None, timeout: float = TIMEOUT, prompt: str = PROMPT, log: str | None = None, in_flight: int = IN_FLIGHT, fill: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Requests, sends and unpacks: a filled record for each document.

    Sends at once, and then reads the replies from the log, however often the result is used. ``log``: a folder that outlives
    the application, so that what has been asked once is never asked again; without it, one that ends with the application.
    """
    log = log or f"{shared_dir(documents.sparkSession)}/log"
    requests = documents.select(*map(named, keep), request_body(F.coalesce(named(text), F.lit("")), catalogue, prompt).alias("request"))
    replies = send_once(requests, transport, log, timeout=timeout, in_flight=in_flight)
    found = requests.withColumn("digest", digest(F.col("request"))).drop("request").join(replies, "digest", "left")
    return unpacked(found, keep, catalogue=catalogue, fill=fill)
