"""Shapes of the tables. ``media_id`` keys a recording, ``idx`` gives the order that Spark rows otherwise lack."""

from __future__ import annotations

from pyspark.sql import types as T

SEGMENT = T.StructType([
    T.StructField("media_id", T.LongType()), T.StructField("idx", T.LongType()),
    T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()),
])
INTERVAL = "media_id bigint, seg_index int, start_ms bigint, end_ms bigint"
SILENCE = "media_id bigint, pos int, s_start double, s_end double"
WORD = "media_id bigint, seg_index int, pos int, word string, start double, end double"
SPEECH_RESPONSE = "results array<struct<alternatives:array<struct<transcript:string,words:array<struct<word:string,startTime:string,endTime:string>>>>>>"
REQUEST = "previous_context_for_reference_only string, segments_to_translate array<struct<id:int,start:double,end:double,text:string>>"
RESPONSE = "segments array<struct<id:int,start:double,end:double,text:string>>"
VIDEO = "title string, subtitles array<struct<pos:int,code:string>>"
