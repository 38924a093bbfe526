"""Explicit schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

SOURCE = T.StructType([
    T.StructField("sketch_image", T.StructType([
        T.StructField("bytes", T.BinaryType()),
        T.StructField("path", T.StringType()),
    ])),
    T.StructField("tikz_code", T.StringType()),
    T.StructField("tool", T.StringType()),
    T.StructField("uri", T.StringType()),
])

RESULT = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("uml_code", T.StringType()),
    T.StructField("uml_valid", T.BooleanType()),
    T.StructField("uml_error", T.StringType()),
    T.StructField("llm_failed", T.BooleanType()),
])

RESPONSE_LINE = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([
        T.StructField("status_code", T.IntegerType()),
        T.StructField("body", T.StructType([
            T.StructField("choices", T.ArrayType(T.StructType([
                T.StructField("message", T.StructType([
                    T.StructField("content", T.StringType()),
                ])),
            ]))),
        ])),
    ])),
])

MANIFEST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("output_file_id", T.StringType()),
    T.StructField("error_file_id", T.StringType()),
    T.StructField("request_counts", T.StructType([
        T.StructField("total", T.LongType()),
        T.StructField("completed", T.LongType()),
        T.StructField("failed", T.LongType()),
    ])),
    T.StructField("created_at", T.LongType()),
    T.StructField("errors", T.StructType([
        T.StructField("data", T.ArrayType(T.StructType([
            T.StructField("code", T.StringType()),
            T.StructField("message", T.StringType()),
        ]))),
    ])),
])

MESSAGE_PART = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
])

CHAT = T.StructType([
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()),
        T.StructField("content", T.ArrayType(MESSAGE_PART)),
    ]))),
    T.StructField("image_bytes", T.BinaryType()),
])

PREDICTION = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("uml_code_gt", T.StringType()),
    T.StructField("uml_pred", T.StringType()),
    T.StructField("uml_valid", T.BooleanType()),
    T.StructField("uml_error", T.StringType()),
    T.StructField("llm_failed", T.BooleanType()),
])

RENDER_RESPONSE = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("http_code", T.IntegerType()),
    T.StructField("reason", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("body", T.BinaryType()),
])
