"""What model replies and form fields say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a reply names its verdict.
AD = r'\btype=ad\b|"classification"\s*:\s*"ad"'
RACING = r'\btype=racing\b|"classification"\s*:\s*"racing"'

#: The JSON that a prompt asks for.
CONTRACT = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("scoreboard", T.StructType([T.StructField("present", T.BooleanType()), T.StructField("position", T.StringType())])),
        T.StructField("layout", T.StringType()),
        T.StructField("primary_subject", T.StringType()),
        T.StructField("race_cars_present", T.BooleanType()),
        T.StructField("corner_sponsor_bug", T.BooleanType()),
        T.StructField("classification", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)


# The two questions, and how long an answer may be.
QUICK = "Does this image contain anything related to NASCAR racing? Reply with only 'yes' or 'no'."
QUICK_WITH_AUDIO = (
    "This image and audio clip are from the same segment of a video. Based on both the audio and the image, does it seem more likely than not "
    "that this segment is from a NASCAR race broadcast (not an ad)? Reply 'Yes' or 'No'."
)
MOST_TOKENS = {"quick": 10, "full": 500}
TEMPERATURE = 0.2


def request(kind: str, model: str, image: Column, prompt: Column | None = None, audio: Column | None = None) -> Column:
    """The JSON of a request to a model, `quick` or `full`: a text, the image (JPEG bytes) and, if not null, the audio (WAV bytes).

    The full question is the prompt. Sending it is the caller's; verdict() and says_yes() read the replies.
    """
    part = "struct<type:string,text:string,image_url:struct<url:string>,input_audio:struct<data:string,format:string>>"
    audio = F.lit(None).cast("binary") if audio is None else audio
    text = prompt if kind == "full" else F.when(audio.isNotNull(), QUICK_WITH_AUDIO).otherwise(QUICK)
    none = lambda t: F.lit(None).cast(t)
    url, sound = "struct<url:string>", "struct<data:string,format:string>"
    parts = F.array(
        F.struct(F.lit("text"), text, none(url), none(sound)).cast(part),
        F.struct(F.lit("image_url"), none("string"), F.struct(F.concat(F.lit("data:image/jpeg;base64,"), F.base64(image))), none(sound)).cast(part),
        F.when(audio.isNotNull(), F.struct(F.lit("input_audio"), none("string"), none(url), F.struct(F.base64(audio), F.lit("wav"))).cast(part)),
    )
    content = F.filter(parts, lambda x: x.isNotNull())
    message = F.struct(F.lit("user").alias("role"), content.alias("content"))
    return F.to_json(
        F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"), F.lit(MOST_TOKENS[kind]).alias("max_tokens"), F.lit(TEMPERATURE).alias("temperature"))
    )


def json_part(reply: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def normal(reply: Column) -> Column:
    return F.lower(F.regexp_replace(reply, r"^\s+|\s+$", ""))


def verdict(reply: Column) -> Column:
    """(type, reason) of a raw reply: patterns first, racing after ad, then the JSON in it; null is unknown for being empty."""
    text = normal(reply)
    said = F.get_json_object(json_part(text), "$.classification")
    kind = (
        F.when(reply.isNull(), "unknown")
        .when(text.rlike(AD), "ad")
        .when(text.rlike(RACING), "content")
        .when(said == "racing", "content")
        .when(said == "ad", "ad")
        .otherwise("unknown")
    )
    return F.struct(kind.alias("type"), F.when(reply.isNull(), "empty_response").otherwise("model-match").alias("reason"))


def says_yes(reply: Column) -> Column:
    return F.coalesce(F.contains(normal(reply), F.lit("yes")), F.lit(False))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "1", "yes"), F.lit(False))


def offset(text: Column) -> Column:
    """Seconds as a number (null if it is none) and as shown."""
    return F.struct(text.try_cast("double").alias("seconds"), F.coalesce(text, F.lit("?")).alias("shown"))


def display(classification: Column) -> Column:
    return (
        F.when(classification.isNull(), "...").when(classification == "ad", "AD").when(classification == "content", "RACING").otherwise("?")
    )


def request_branch(has_image: Column, seeking: Column, paused: Column) -> Column:
    """What a request without an image means: seeking before paused, else it is rejected."""
    return F.when(has_image, "frame").when(seeking, "seeking").when(paused, "paused").otherwise("reject")
