"""Marketplace reporting on Spark: intake, star schema, rollups, reports."""
