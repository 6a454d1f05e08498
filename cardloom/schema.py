"""Schemas (as DDL) of the tables that the engine works on. Everything but notes is derived and can be rebuilt."""

NOTES = "note_id bigint, guid string, note_type string, deck string, tags array<string>, modified timestamp, fields array<struct<ord:int,name:string,value:string>>"
NOTE_TYPES = "type_id bigint, name string, kind string, fields array<struct<ord:int,name:string>>, templates array<struct<ord:int,name:string,front:string,back:string>>, css string"
CARDS = "card_id bigint, note_id bigint, ord int, deck_id bigint, original_deck_id bigint, queue string"
DECKS = "deck_id bigint, name string"
SEGMENTS = "seg_id bigint, note_id bigint, source string, ref string, text string"
VECTORS = "space string, modality string, note_id bigint, item int, vec array<float>"
RECOGNITIONS = "note_id bigint, source string, ref string, text string, confidence double, segments array<struct<text:string,confidence:double,bbox:array<double>,span:array<double>>>"
RANKINGS = "query_id bigint, signal string, note_id bigint, rank bigint"
CHANGES = "note_id bigint, col_mod bigint, kind string, success boolean"

#: Sources whose text is never searched literally.
HIDDEN_SOURCES = ("vlm",)
FIELD_SEPARATOR = "\x1f"
CLOZE = "cloze"
