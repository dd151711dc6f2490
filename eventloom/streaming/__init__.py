"""Streaming forms of the stateful operators.

Two kinds. Aggregates that are sent when an hour or a session is over (`hourly_stream`,
`sessionize_stream`) and `dedup_stream` are built-in operators with event time and the
one watermark of the configuration; what is later than that is not in their output. Rows
that must all go on are handled batch by batch (`batches`), with the batch operators and
a state that is kept by arrival, so a late row is a row like others. Identity and the
session sweep also exist as keyed state with timers (`keyed`).
"""
