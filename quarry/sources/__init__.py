"""Scans of files: id lists, chart folders, archives, JSON in its shapes, images. All paths are read by Spark."""

from .files import chart_ids, id_list, json_files, json_records, manifest_ids, saved, with_both, whole_texts, zip_members
from .images import decode_png, pixels
from .options import ScanOptions

__all__ = ["ScanOptions", "chart_ids", "decode_png", "id_list", "json_files", "json_records", "manifest_ids", "pixels", "saved", "whole_texts", "with_both", "zip_members"]
