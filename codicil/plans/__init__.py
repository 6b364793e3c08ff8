"""Whole plans: conversion of many files, and where their outputs go."""
