"""Schemas of the engine's tables, as DDL."""

EATERY = "osm_id string, name map<string,string>, amenity string, cuisine string, tags map<string,string>, lat double, lon double"
STATION = "name map<string,string>, lat double, lon double, operator string, station string"
ENTITY = "qid string, requested string, label map<string,string>, `desc` map<string,string>, wiki_count int, wiki_titles map<string,string>, instance_of array<string>, heritage array<string>, coord struct<lat:double,lon:double>, image string, website string, missing boolean"
PAGEVIEWS = "qid string, title string, views_12m bigint, views_36m bigint, monthly map<string,bigint>"
PLACE = "fsq_place_id string, name string, latitude double, longitude double, locality string, region string, postcode string, date_refreshed string, date_closed string, fsq_category_ids array<string>, fsq_category_labels array<string>, unresolved_flags array<string>"
LABEL = "id string, cat string, conf string, stage int, phash string, model string, evidence_url string"
OBJECT = "osm_id string, kind string, tags map<string,string>, rings array<array<struct<lat:double,lon:double>>>"
ITEM = "id string, name string, name_ja string, brand string, category string, cuisine string, sub string, fine array<string>, broad string, lat double, lon double, popularity double, pop_tier int, wikidata string, sources array<string>, local double, known double, hidden double, season array<double>"
TURN = "id string, actor string, trip_id string, turn_no int, source string, query string, intent string, context struct<area_geo:string,month:int>, candidates string, answer string, versions string, latency_ms int, created_at timestamp"
REACTION = "id bigint, turn_id string, actor string, trip_id string, place_id string, rank int, type string, props string, created_at timestamp"
RULE = "priority int, category string, pattern string, note string"
