"""Column sets of the catalog's tables."""

from __future__ import annotations

TRACK_COLUMNS = (
    "id", "filepath", "filename", "directory", "title", "artist", "album", "album_artist", "genre", "year", "duration", "file_size", "file_format", "bitrate", "sample_rate",
    "matched_title", "matched_artist", "matched_album", "matched_album_artist", "matched_genre", "matched_year", "matched_cover_url", "matched_tracklist_url", "matched_dj", "matched_event",
    "match_confidence", "match_source", "status", "error_message", "series_tagged", "fingerprint_hash", "created_at", "updated_at", "tagged_at",
)
#: What a track looks like to callers: without sample rate, match source and the series mark.
RESPONSE_COLUMNS = tuple(c for c in TRACK_COLUMNS if c not in ("sample_rate", "match_source", "series_tagged"))
PATCH_COLUMNS = ("title", "artist", "album", "album_artist", "genre", "year", "matched_title", "matched_artist", "matched_album", "matched_album_artist", "matched_genre", "matched_year", "matched_cover_url", "status")
CANDIDATE_COLUMNS = ("id", "track_id", "title", "artist", "genre", "cover_url", "tracklist_url", "dj", "event", "date_recorded", "source", "extracted_tracks", "num_tracks", "confidence", "match_type")
DUPLICATE_COLUMNS = ("id", "filename", "filepath", "directory", "title", "artist", "duration", "file_size", "bitrate")
STATUSES = ("pending", "matched", "tagged", "error")
MATCH_THRESHOLD, AUTO_ACCEPT = 50.0, 85.0
EXTRACTED_TRACKS = "array<struct<position:int,artist:string,title:string,time:string>>"
