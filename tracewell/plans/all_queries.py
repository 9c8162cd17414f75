"""Every query of the engine's own operators."""

from tracewell.plans import bundle_queries, evidence_queries, listing_queries, more_queries, reading_queries, record_queries, report_queries, seam_queries, source_queries, span_queries, speech_queries, stream_queries, text_queries, trace_queries, visual_queries  # noqa: F401
from tracewell.plans.registry import QUERIES, SQL  # noqa: F401
