"""What the parser's signals tell of a page: whether it was read in full."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From these shares of the page and numbers of characters on, images may hide text.
SCANNED_RATIO, SCANNED_CHARS, UNREAD_RATIO, UNCERTAIN_CHARS = 0.6, 200, 0.5, 200


def page_status(digital_chars: Column, image_count: Column, image_area_ratio: Column, has_unread_image_region: Column, ocr_state: Column, ocr_chars: Column, ocr_min_chars: int = 1) -> Column:
    """The first step that applies: what OCR came to, then what images and digital text there are."""
    return (
        F.when(ocr_state == "success", F.when(ocr_chars < ocr_min_chars, "ocr_insufficient").otherwise("ocr"))
        .when(ocr_state == "insufficient", "ocr_insufficient")
        .when(ocr_state == "failed", "ocr_failed")
        .when(ocr_state == "skipped_limit", "ocr_skipped_limit")
        .when((image_count == 0) & (digital_chars == 0), "empty")
        .when((image_count > 0) & (digital_chars == 0), "scanned_no_text")
        .when((image_area_ratio >= SCANNED_RATIO) & (digital_chars < SCANNED_CHARS), "scanned_minimal_text")
        .when(has_unread_image_region & (image_area_ratio >= UNREAD_RATIO) & (digital_chars >= UNCERTAIN_CHARS), "mixed_image_unread")
        .otherwise("ok")
    )
