"""Schemas of the catalogue's tables, of API records and of webhook batches."""

from __future__ import annotations

#: Table -> DDL. Keys: id, or those in KEYS; references in REFERENCES.
TABLES = {
    "Event": "id string, title string, description string, eventDate timestamp, startTime string, endTime string, venue string, address string, location string, detailUrl string, organizationId string, createdAt timestamp, updatedAt timestamp, image string, format string, difficulty string, price int, eventType string, embedding array<double>, keywords array<string>, keyPhrases array<string>, keySentences array<string>",
    "EventCategory": "id string, eventId string, categoryId string, createdAt timestamp, updatedAt timestamp",
    "EventGoal": "id string, goalType string, eventId string, createdAt timestamp, updatedAt timestamp",
    "EventSkill": "id string, name string, eventId string, createdAt timestamp, updatedAt timestamp",
    "EventSpeaker": "id string, eventId string, speakerId string, createdAt timestamp, updatedAt timestamp",
    "Category": "id string, name string",
    "Organization": "id string, name string, description string, website string, email string, createdAt timestamp, updatedAt timestamp",
    "Speaker": "id string, name string, occupation string, affiliation string, bio string, createdAt timestamp, updatedAt timestamp",
    "Bookmark": "id string, userId string, eventId string, createdAt timestamp",
    "User": "id string, name string, email string, lineId string, stack array<string>, level string, place string, tag array<string>, goal array<string>, affiliation array<string>",
    "Account": "id string, userId string, provider string, providerAccountId string",
    "Session": "id string, sessionToken string, userId string, expires timestamp",
}
UNIQUE = {"User": [["email"], ["lineId"]], "Category": [["name"]], "Bookmark": [["userId", "eventId"]], "Account": [["provider", "providerAccountId"]], "Session": [["sessionToken"]]}
REFERENCES = {
    "Event": {"organizationId": "Organization"}, "EventCategory": {"eventId": "Event", "categoryId": "Category"}, "EventGoal": {"eventId": "Event"},
    "EventSkill": {"eventId": "Event"}, "EventSpeaker": {"eventId": "Event", "speakerId": "Speaker"}, "Bookmark": {"userId": "User", "eventId": "Event"},
    "Account": {"userId": "User"}, "Session": {"userId": "User"},
}
#: References that forbid a delete; all others pass it on.
RESTRICTED = [("Event", "organizationId")]
ENUMS = {
    "format": ["ONLINE", "OFFLINE", "HYBRID"], "difficulty": ["BEGINNER", "INTERMEDIATE", "ADVANCED", "FOR_EVERYONE"],
    "eventType": ["HACKATHON", "WORKSHOP", "CONTEST", "LIGHTNING_TALK", "OTHER"],
}

API_EVENT = (
    "id bigint, title string, catch string, description string, url string, started_at string, ended_at string, `limit` int, hash_tag string, event_type string, "
    "accepted int, waiting int, updated_at string, owner struct<id:bigint,nickname:string,display_name:string>, place string, address string, lat double, lon double, "
    "`group` struct<id:bigint,title:string,url:string>, tags array<string>"
)
API_PAGE = f"total int, count int, offset int, events array<struct<{API_EVENT}>>"
WEBHOOK = "events array<struct<type:string,timestamp:bigint,source:struct<userId:string>,postback:struct<data:string>,message:struct<type:string,text:string>>>"
