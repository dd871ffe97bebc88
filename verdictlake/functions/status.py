"""Status of a model response, read from its JSON by path: a chain of columns without Python in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Finish reasons by what they mean.
SUCCESS = ("stop", "STOP", "completed", "end_turn", "eos_token", "eos", "stop_sequence")
MODERATION = ("content_filter", "PROHIBITED_CONTENT", "RECITATION", "refusal", "sensitive")
TRUNCATION = ("length", "MAX_TOKENS", "max_output_tokens", "max_tokens")
PROVIDER_ERROR = ("engine_overloaded", "error")
METADATA_ERROR = ("OTHER",)
# Wording of errors that are moderation.
MODERATION_TEXT = (
    r"(?i)(usage policy|requires moderation|input was flagged|prompt was flagged|output data may contain inappropriate content|"
    r"input data may contain inappropriate content|(?:input|output) text data may contain inappropriate content|data_inspection_failed|"
    r"prohibited_content|content_policy_violation|\brecitation\b|content[_ -]?filter|content (?:you provided or machine outputted )?is blocked|"
    r"content violates safety guidelines|safety policy|SAFETY_CHECK_TYPE|\bcensorship\b|policy violation|blocked by (?:safety|moderation)|"
    r"limited access to this content for safety reasons|\bmoderation\b)"
)
#: A key of a JSON document with its colon.
JSON_KEY = r'"(?:[^"\\]|\\.)*"\s*:'
#: An empty answer with at most this many completion tokens counts as suppressed.
SUPPRESSED_TOKENS = 8


class Response:
    """Columns of one response: `json` is the response document, `model` the model's name.

    A path that doesn't lead to a value gives null.  Where a field must be text, a document or list there counts as
    absent; get_json_object can't tell a number from text, so numbers in such fields count as text.
    """

    def __init__(self, json: Column, model: Column):
        self.json, self.model = json, model
        self.choice = self._object("$.choices[0]")
        self.sidecar = "$._llm_client.standardized_response"
        self.info = "$._llm_client.error_info"

    def at(self, path: str) -> Column:
        return F.get_json_object(self.json, path)

    def _text(self, path: str) -> Column:
        value = self.at(path)
        return F.when(~value.rlike(r"^\s*[\[{]"), value)

    def _object(self, path: str) -> Column:
        value = self.at(path)
        return F.when(value.rlike(r"^\s*\{"), value)

    def finish_source(self) -> Column:
        """The field that holds the finish reason."""
        return F.when(self._text("$.choices[0].finish_reason").isNotNull(), "finish_reason").when(self._text("$.stop_reason").isNotNull(), "stop_reason").when(self._text(f"{self.sidecar}.finish_reason").isNotNull(), "_llm_client.standardized_response.finish_reason")

    def finish(self) -> Column:
        return F.coalesce(self._text("$.choices[0].finish_reason"), self._text("$.stop_reason"), self._text(f"{self.sidecar}.finish_reason"))

    def native(self) -> Column:
        """P4."""
        return F.coalesce(*[self._text(f"{p}.native_finish_reason") for p in ("$.choices[0]", self.sidecar, self.info)])

    def _blocks(self, path: str, only_text: bool) -> Column:
        """Joined text of a list of content blocks; null where the path holds no list."""
        value = self.at(path)
        blocks = F.from_json(value, "array<struct<type:string,text:string>>")
        kept = F.filter(blocks, lambda b: b["text"].isNotNull() & ((b["type"] == "text") if only_text else F.lit(True)))
        return F.when(value.rlike(r"^\s*\["), F.struct(F.size(kept).alias("n"), F.array_join(F.transform(kept, lambda b: b["text"]), "").alias("text")))

    def text(self) -> Column:
        """The final answer's text, empty if there is none."""
        plain, listed = self._text("$.choices[0].message.content"), self._blocks("$.choices[0].message.content", False)
        own, side = self._blocks("$.content", True), self._blocks(f"{self.sidecar}.content", False)
        return F.coalesce(plain, listed["text"], F.when(own["n"] > 0, own["text"]), self._text(f"{self.sidecar}.content"), side["text"], F.lit(""))

    def _error(self, path: str) -> Column:
        value = self.at(path)
        return F.when(~value.isin("", "{}", "[]", "0", "false", "null"), value)

    @staticmethod
    def _worded(error: Column) -> Column:
        """Does a string value of an error tell of moderation?  Names of fields don't count."""
        return F.when(error.rlike(r"^\s*[\[{]"), F.regexp_replace(error, JSON_KEY, "")).otherwise(error).rlike(MODERATION_TEXT)

    def has_error(self) -> Column:
        return self._error("$.error").isNotNull() | self._error("$.choices[0].error").isNotNull()

    def provider_error(self) -> Column:
        """The first error that stands there says the reason; null if it is worded as moderation."""
        out, above = F.lit(None).cast("string"), []
        for path, name, fields in (("$.error", "top_error", ("code",)), ("$.choices[0].error", "choice_error", ("code",)), (self.info, "llm_client_error", ("status_code", "code"))):
            error = self._error(path)
            detail = [F.concat(F.lit(f"{name}_{'status' if f == 'status_code' else f}:"), self.at(f"{path}.{f}")) for f in fields]
            reason = F.coalesce(*detail, F.concat(F.lit(f"{name}:"), self._text(f"{path}.type")), F.lit(name))
            first = reduce(lambda a, b: a & b, [e.isNull() for e in above], error.isNotNull())
            out = F.coalesce(out, F.when(first & ~self._worded(error), reason))
            above.append(error)
        return F.when(self.json.rlike(r"^\s*\{"), out).otherwise("response_not_dict")

    def suppressed(self) -> Column:
        """P10: success was reported, but there is no text."""
        reasons = F.array_compact(F.array(self.finish(), self.native()))
        tokens = F.try_to_number(self.at("$.usage.completion_tokens"), F.lit("999999999999"))
        good = (F.size(reasons) > 0) & F.forall(reasons, lambda r: r.isin(*SUCCESS))
        return (self.text() == "") & ~self.has_error() & good & (F.startswith(self.model, F.lit("anthropic/")) | F.coalesce(tokens <= SUPPRESSED_TOKENS, F.lit(False)))

    def moderation(self) -> Column:
        """The original provider's moderation reason, or null."""
        finish, native = self.finish(), self.native()
        truncated = F.coalesce(finish.isin(*TRUNCATION), F.lit(False)) | F.coalesce(native.isin(*TRUNCATION), F.lit(False))
        typed = lambda path: self._text(f"{path}.type") == "content_filter"
        worded = lambda path: self._worded(self._error(path))
        rules = (
            F.when(self.provider_error().isNotNull() | truncated, F.lit(None).cast("string"))
            .when(finish.isin(*MODERATION), finish)
            .when(native.isin(*MODERATION), native)
            .when(typed(self.info), F.coalesce(self._text(f"{self.info}.native_finish_reason"), self._text(f"{self.info}.finish_reason"), F.lit("content_filter")))
            .when(self.suppressed(), "empty_stop_content_suppressed")
            .when(typed("$.error"), "content_filter")
            .when(worded("$.error"), "moderation_error_text")
            .when(typed("$.choices[0].error"), "content_filter")
            .when(worded("$.choices[0].error"), "moderation_error_text")
        )
        return rules

    def status(self) -> Column:
        """Struct (status, reason) by the first rule that holds."""
        finish, native, source = self.finish(), self.native(), self.finish_source()
        pair = lambda status, reason: F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
        named = F.concat_ws(":", source, finish)
        native_named = F.concat(F.lit("native_finish_reason:"), native)
        known = SUCCESS + MODERATION + TRUNCATION + PROVIDER_ERROR + METADATA_ERROR
        strange = F.concat_ws(";", F.when(~finish.isin(*known), F.concat(F.lit("unknown_"), named)), F.when(~native.isin(*known), F.concat(F.lit("unknown_"), native_named)))
        moderation, error = self.moderation(), self.provider_error()
        has = lambda key: F.array_contains(F.json_object_keys(self.json), key)
        rules = (
            F.when(self.json.isNull() | ~self.json.rlike(r"^\s*\{\s*[^}\s]"), pair("empty_response", "empty_response"))
            .when(finish.isin(*TRUNCATION), pair("truncation", named))
            .when(native.isin(*TRUNCATION), pair("truncation", native_named))
            .when(moderation.isNotNull(), pair("moderation", moderation))
            .when(error.isNotNull(), pair("provider_error", error))
            .when(has("choices") & self.choice.isNull(), pair("unknown_metadata", "malformed_choices"))
            .when(self.choice.isNotNull() & self.at("$.choices[0].finish_reason").isNull(), pair("metadata_error", "missing_finish_reason"))
            .when(finish.isNull() & native.isNull(), pair("unknown_metadata", F.when(has("content"), "missing_stop_reason").otherwise("unrecognized_response_shape")))
            .when(strange != "", pair("unknown_metadata", strange))
        )
        for status, reasons in (("moderation", MODERATION), ("truncation", TRUNCATION), ("provider_error", PROVIDER_ERROR), ("metadata_error", METADATA_ERROR)):
            rules = rules.when(finish.isin(*reasons), pair(status, named)).when(native.isin(*reasons), pair(status, native_named))
        return rules.when(self.text() == "", pair("missing_content", "missing_final_content")).otherwise(pair("success", F.concat_ws(";", F.when(finish.isNotNull(), named), native_named)))


def reasoning_summary(r: Response) -> Column:
    """Struct of what a response's payload holds of content and reasoning."""
    plain = r.at("$.choices[0].message.content")
    blocks = F.from_json(r.at("$.content"), "array<struct<type:string,text:string,thinking:string,data:string,redacted_thinking:string>>")
    of = lambda *types: F.coalesce(F.filter(blocks, lambda b: b["type"].isin(*types)), F.array().cast("array<struct<type:string,text:string,thinking:string,data:string,redacted_thinking:string>>"))
    block_chars = F.aggregate(of("text"), F.lit(0), lambda a, b: a + F.length(F.coalesce(b["text"], F.lit(""))))
    details = r.at("$.choices[0].message.reasoning_details")
    listed = F.size(F.from_json(details, "array<string>"))
    n_details = F.when(details.rlike(r"^\s*\["), listed).when(details.isNotNull() & ~details.isin("", "{}"), 1).otherwise(0) + F.size(of("thinking", "redacted_thinking"))
    thought = F.exists(of("thinking"), lambda b: F.trim(F.coalesce(b["thinking"], b["text"], F.lit(""))) != "")
    hidden = F.exists(of("redacted_thinking"), lambda b: F.coalesce(b["data"], b["redacted_thinking"], F.lit("")) != "")
    has_text = (F.coalesce(r.at("$.choices[0].message.reasoning"), F.lit("")) != "") | thought
    has_details = F.coalesce(F.when(details.rlike(r"^\s*\["), listed > 0).otherwise(details.isNotNull() & ~details.isin("", "{}")), F.lit(False)) | hidden
    tokens = F.try_to_number(r.at("$.usage.completion_tokens_details.reasoning_tokens"), F.lit("999999999999")).cast("long")
    chars = F.when(block_chars > 0, block_chars).otherwise(F.coalesce(F.length(plain), F.lit(0)))
    return F.struct(
        r.at("$.provider").alias("provider"), r.at("$.model").alias("response_model"), F.coalesce(r.at("$.choices[0].finish_reason"), r.at("$.stop_reason")).alias("finish_reason"),
        F.coalesce(r.at("$.error"), r.at("$.choices[0].error")).alias("error"), (chars > 0).alias("has_content"), chars.alias("content_chars"), has_text.alias("has_reasoning_text"),
        has_details.alias("has_reasoning_details"), n_details.alias("reasoning_detail_count"), tokens.alias("reasoning_tokens"), (has_text | has_details | F.coalesce(tokens != 0, F.lit(False))).alias("reasoning_present"),
    )


def finish_status(reason: Column) -> Column:
    """The status that one finish reason stands for."""
    return F.when(reason.isin(*MODERATION), "moderation").when(reason.isin(*TRUNCATION), "truncation").when(reason.isin(*PROVIDER_ERROR), "provider_error").when(reason.isin(*METADATA_ERROR), "metadata_error").when(reason.isin(*SUCCESS), "success").otherwise("unknown_metadata")


def retry_candidate(status: Column) -> Column:
    """Rows that are collected again."""
    return status.isin("provider_error", "empty_response", "missing_content")
